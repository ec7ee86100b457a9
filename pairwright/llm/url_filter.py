"""Allow and block rules for urls: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import shared, unused


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    """A trie node; ``rules`` holds the last, perhaps unfinished, path segment of each rule that ends here."""

    children: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    rules: dict[str, Rule] = field(default_factory=dict)


def _better(new: Rule, old: Rule | None) -> bool:
    """Longest text wins; then the longer host; then block."""
    return old is None or (len(new.text), len(new.host), new.verdict == "block") > (len(old.text), len(old.host), old.verdict == "block")


def build_trie(rules: Iterable[Rule]) -> Node:
    """The trie of the rules; an empty host fits any host."""
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")) if rule.host else ():
            node = node.children.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node.children.setdefault(segment, Node())
        if _better(rule, node.rules.get(last)):
            node.rules[last] = rule
    return root


def best_rule(root: Node, host: str, path: str) -> Rule | None:
    """The winning rule, by one walk along the host and one walk along the path for each host node with rules."""
    best, node, segments = None, root, path.split("/")
    labels = iter(reversed(host.split(".")) if host else ())
    while node is not None:
        at = node.paths
        for segment in segments if at else ():
            for end in range(len(segment) + 1) if at.rules else ():
                if (rule := at.rules.get(segment[:end])) and _better(rule, best):
                    best = rule
            if (at := at.children.get(segment)) is None:
                break
        node = node.children.get(label) if (label := next(labels, None)) is not None else None
    return best


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first :// up to / ? # or the end, lower-cased; then up to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", most_broadcast: int = 1_000_000) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    A rule fits its host and all subdomains if the url's path starts with the rule's. The longest rule text wins, then
    the longer host, then block over allow. Without a rule: rule null, verdict ``default``. A null url, or one without
    ``://``, has an empty host and path. Rows are kept as they are, repeated ones too; columns of these four names are
    replaced. Up to ``most_broadcast`` rules go to the executors as one trie; more are joined as a table.
    """
    rest = pages.drop("host", "path", "rule", "verdict")
    host, path = url_parts(rest[url])
    parted = rest.withColumns({"host": host, "path": path})
    if len(rules) > most_broadcast:
        spark = pages.sparkSession
        listed = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
        return judge_by_join(parted, listed, default)
    trie = shared(pages.sparkSession, build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [best_rule(trie(), h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [r.text if r else None for r in found], "verdict": [r.verdict if r else default for r in found]}, dtype=object)

    judged = unused(parted, "judged")
    return parted.withColumn(judged, judge("host", "path")).select(*parted.columns, f"{judged}.rule", f"{judged}.verdict")


def judge_by_join(parted: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same judgement for a rule table (verdict, host, path) of any size: every distinct (host, path) is joined with
    the rules on each suffix of its host and each whole-segment prefix of its path; the winner is an aggregate."""
    keys = parted.select("host", "path").distinct()
    labels = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(F.array_append(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"), F.lit("")))
    stems = F.expr("transform(sequence(0, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    asked = keys.withColumn("h", F.explode(labels)).withColumn("stem", F.explode(stems)).withColumn("n_stem", F.size(F.split("stem", "/")))
    ends = F.expr("array_join(slice(split(path, '/'), 1, size(split(path, '/')) - 1), '/')")
    offered = rules.select(F.col("host").alias("h"), ends.alias("stem"), F.col("path").alias("rule_path"), "verdict")
    fits = asked.join(offered, ["h", "stem"]).where(F.expr("startswith(path, rule_path)"))
    rank = F.struct((F.length("h") + F.length("rule_path")).alias("n"), F.length("h").alias("m"), (F.col("verdict") == "block").alias("b"), F.concat("h", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("r")).select("host", "path", "r.rule", "r.verdict")
    return parted.join(best, ["host", "path"], "left").select(*parted.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
