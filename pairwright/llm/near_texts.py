"""Near-duplicates by exact Jaccard similarity of five-word shingle sets: at least four fifths."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut, shared, small, unused, whole_groups
from pairwright.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 5
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of all runs of five words, sorted; a shorter text has one of all its words, none has none."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k, factor in enumerate(FACTORS):
        out = (out ^ h[k : len(h) - SHINGLE + 1 + k]) * factor
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def frequent(texts: DataFrame, share: int = 16, least: int = 4, most: int = 100_000) -> np.ndarray:
    """Shingles that stand in at least ``least`` of one in ``share`` texts, rarest first.

    They only set the order in which prefixes are taken, so what they miss costs time but no pair.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.int64), *map(shingles, f["text"])])})

    found = texts.where(F.pmod("node", F.lit(share)) == 0).select("text").mapInPandas(run, "h long").groupBy("h").count()
    top = found.where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).select("h").collect()
    return np.array([r.h for r in top][::-1], np.int64)


def prefixes(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(k, node, n, pos): the first shingles of each text and their places, of which texts of similarity 0.8 must share some.

    Shingles are ordered by rarity, then by hash. A text of n has n - ceil(4n/5) + 1 of them in its prefix.
    """
    at = np.argsort(hot)
    get = shared(texts.sparkSession, (hot[at], at + 1))

    def first(text: str | None) -> tuple[np.ndarray, int]:
        h, (known, rank) = shingles(text), get()
        n = len(h)
        most = n - (4 * n + 4) // 5 + 1 if n else 0
        if len(known) and n:
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            often = known[place] == h
            rare = h[~often]  # sorted by hash already
            if len(rare) < most:
                rest = h[often]
                rare = np.concatenate([rare, rest[np.argsort(rank[place[often]], kind="stable")]])
            h = rare
        return h[:most], n

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 1000):
                part = f.iloc[lo : lo + 1000]
                got = [first(t) for t in part["text"]]
                sizes = [len(h) for h, _ in got]
                yield pd.DataFrame({"k": np.concatenate([h for h, _ in got]), "node": np.repeat(part["node"].to_numpy(), sizes), "n": np.repeat([n for _, n in got], sizes).astype(np.int32), "pos": np.concatenate([np.empty(0, np.int32), *(np.arange(s, dtype=np.int32) for s in sizes)])})

    return texts.mapInPandas(run, "k long, node long, n int, pos int")


def meetings(frames: Iterable[pd.DataFrame], hub: bool, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """For frames sorted by (k, i, j, n, node): pairs of a group whose sizes, places and components allow a link.

    Two texts of similarity 0.8 have an overlap of at least 4/9 of their sizes' sum. Where their first common shingle stands,
    at most the shingles from there on are common, so that each of them must have so many left. With the larger text given,
    this and the sizes leave a range of sizes for the smaller one, so only pairs of such ranges are looked at: letters of one
    form that share a little less than they should don't meet at all. Pairs may come more than once. ``hub``: only those with the
    group's first text.
    """
    for f in whole_groups(frames, ["k", "i", "j"]):
        keys = f[["k", "i", "j", "node"]].to_numpy()
        f = f[np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]]
        keys = f[["k", "i", "j"]].to_numpy()
        group = np.cumsum(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        node, n, c, s, pos = (f[x].to_numpy() for x in ("node", "n", "c", "s", "pos"))
        cross, left, head = (f["i"] != f["j"]).to_numpy(), n - pos, np.searchsorted(group, group)
        # the place of a size in its group: groups and sizes together are in order
        wide = int(n.max(initial=0)) + 1
        order = group.astype(np.int64) * wide + n
        rows = np.arange(len(f))
        low = np.maximum(np.searchsorted(order, group * wide + -(-4 * n.astype(np.int64) // 5)), head)
        high = np.minimum(np.searchsorted(order, group * wide + np.clip(9 * left.astype(np.int64) // 4 - n, -1, wide - 1), side="right"), rows)
        # a group that is one component already has nothing to link
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        alone = np.minimum.reduceat(c, begins) == np.maximum.reduceat(c, begins)
        high = np.where(alone[group - 1], low, high)
        if hub:
            high = np.where(low <= head, np.minimum(high, head + 1), low)
        many = np.maximum(high - low, 0)
        ends = np.cumsum(many)
        first = 0
        while first < len(rows):  # some rows at a time, of together about ``most`` pairs
            last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")), first + 1)
            size = many[first:last]
            a = np.repeat(rows[first:last], size)
            b = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[first:last], size)
            first = last
            least = -(-4 * (n[a].astype(np.int64) + n[b]) // 9)
            ok = (c[a] != c[b]) & (left[a] >= least) & (left[b] >= least) & (~cross[a] | (s[a] != s[b]))
            a, b = a[ok], b[ok]
            if len(a):
                up = node[a] < node[b]
                x, y = np.where(up, a, b), np.where(up, b, a)
                yield pd.DataFrame({"a": node[x], "b": node[y], "na": n[x], "nb": n[y]})


def verified(texts: DataFrame, met: DataFrame, keyed: DataFrame) -> DataFrame:
    """(a, b) of the pairs of ``met`` that share four fifths of their shingles, all counted.

    Of two texts with overlap o the one whose prefix ends first has at most n - o shingles that the other lacks, so both
    prefixes (``keyed``: k, node) share at least the rest; pairs that share fewer are dropped before their sets are read.
    """
    least = F.ceil(4 * (F.col("na") + F.col("nb")) / 9)
    need = lambda n: least - F.ceil(4 * F.col(n) / 5) + 1
    pairs = cut(met.distinct())
    nodes = lambda p: small(p.select(F.col("a").alias("node")).union(p.select(F.col("b").alias("node"))).distinct())
    starts = cut(keyed.join(nodes(pairs), "node", "left_semi").groupBy("node").agg(F.collect_set("k").alias("h")))
    both = lambda p, sets: p.join(sets.select(F.col("node").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("y")), "b")
    pairs = cut(both(pairs, starts).where(F.size(F.array_intersect("x", "y")) >= F.least(need("na"), need("nb"))).select("a", "b"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["node"], "h": list(map(shingles, f["text"]))})

    sets = cut(texts.join(nodes(pairs), "node", "left_semi").dropDuplicates(["node"]).select("node", "text").mapInPandas(run, "node long, h array<long>"))
    return both(pairs, sets).where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def near_links(texts: DataFrame, hub_rows: int = 64, block_rows: int = 2048) -> DataFrame:
    """Links (a, b) between nodes of ``texts`` (node, text): what they connect is what all pairs of similarity 0.8 connect.

    Shingles shared by over ``hub_rows`` texts first link each of them to one, so that a large group of near copies is
    one component before all pairs of different components are compared; no pair is left out.
    """
    keyed = cut(prefixes(texts, frequent(texts)))
    # most shingles stand in one prefix only and are done with here
    counts = keyed.groupBy("k").count().where(F.col("count") > 1).select("k", "count", F.ceil(F.col("count") / block_rows).cast("int").alias("m"))
    keyed = cut(keyed.join(cut(counts), "k"))

    def met(rows: DataFrame, hub: bool) -> DataFrame:
        dealt = rows.withColumn("s", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("t"))
        dealt = dealt.select("k", "node", "n", "pos", "c", "s", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"))
        ready = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "n", "node")
        return ready.mapInPandas(lambda frames: meetings(frames, hub), "a long, b long, na int, nb int")

    one = cut(verified(texts, met(keyed.where(F.col("count") > hub_rows).withColumn("c", F.col("node")), True), keyed))
    known = small(components(one).select("node", F.col("component").alias("c")))
    return one.unionByName(verified(texts, met(keyed.join(known, "node", "left").withColumn("c", F.coalesce("c", "node")), False), keyed))


def keep_one_text(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text) for each group of texts that links of similarity 0.8 connect; all columns stay.

    It is the row with the smallest doc_id; rows without an id come last, then the text with the smallest hash. Rows of
    one text stay or go together, and a text without words is in no group. Other rows are kept as they are.
    """
    name = unused(docs, "node")
    marked = docs.withColumn(name, F.xxhash64("text"))
    texts = marked.where("text is not null").select(F.col(name).alias("node"), "text")
    linked = small(components(near_links(texts)))
    found = cut(marked.select("doc_id", F.col(name).alias("node")).join(linked, "node"))
    best = cut(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best")))
    gone = small(found.join(best, "component").where("node <> best.node").select(F.col("node").alias(name)).distinct())
    return marked.join(gone, name, "left_anti").select(*docs.columns)
