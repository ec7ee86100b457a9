"""Near-duplicates by SimHash fingerprints, found through pigeonhole blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut, local_components, small, text_key, unused, whole_groups
from pairwright.llm.components import components
from pairwright.llm.near_texts import keep_one_text

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint_of(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text; a text without words has zero."""
    words = WORD.findall((text or b"").lower())  # of bytes, lower() changes A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed long; a null text counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text.cast("binary"))


def block_keys(fp: Column, distance: int = 4, blocks: int | None = None) -> Column:
    """The keys that two fingerprints share if at most ``distance`` bits differ.

    The 64 bits are cut into ``blocks``, by default ``distance`` + 2, of which all but ``distance`` at least are untouched;
    every choice of so many blocks is a key. Two of six blocks hold about 21 bits.
    """
    n = blocks or distance + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(fp, 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i]) for i in range(n)]
    pairs = list(combinations(range(n), n - distance))
    keys = []
    for k, chosen in enumerate(pairs):
        key = F.lit(k).cast("long")
        for c in chosen:
            key = F.shiftleft(key, edges[c + 1] - edges[c]).bitwiseOR(part[c])
        keys.append(key)
    return F.array(*keys)


def blocks_for(n: int, distance: int = 4, most_a_key: int = 256) -> int:
    """Into how many blocks to cut fingerprints, so that a key of untouched blocks meets few of ``n`` by chance.

    More blocks make longer keys, but more of them: 15 of 21 bits for up to some 680 million, then 35 of 27 bits, then 70 of 32.
    """
    blocks = distance + 2
    while blocks < distance + 4 and n > most_a_key << (64 * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def links_in(frames: Iterable[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """For frames sorted by (k, i, j): each group's links, thinned to a spanning forest."""
    for f in whole_groups(frames, ["k", "i", "j"]):
        fp = f["fp"].to_numpy().view(np.uint64)
        group = np.concatenate([[0], np.cumsum((f[["k", "i", "j"]].to_numpy()[1:] != f[["k", "i", "j"]].to_numpy()[:-1]).any(axis=1))])
        side, cross = f["s"].to_numpy(), (f["i"] != f["j"]).to_numpy()
        last = np.searchsorted(group, group, side="right")  # end of each row's group
        found_a, found_b = [], []
        rows, step = np.arange(len(f)), 1
        while len(rows := rows[rows + step < last[rows]]):
            near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= distance
            near &= ~cross[rows] | (side[rows] != side[rows + step])
            found_a.append(rows[near])
            found_b.append(rows[near] + step)
            step += 1
            if step % 64 == 0:  # keeps what is held in proportion to the rows
                found_a, found_b = _thinned(len(f), found_a, found_b)
        found_a, found_b = _thinned(len(f), found_a, found_b)
        fps = f["fp"].to_numpy()
        yield pd.DataFrame({"a": fps[found_a[0]], "b": fps[found_b[0]]})


def _thinned(n: int, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    label = local_components(n, np.concatenate([*a, np.empty(0, int)]).astype(int), np.concatenate([*b, np.empty(0, int)]).astype(int))
    moved = np.flatnonzero(label != np.arange(n))
    return [moved], [label[moved]]


def near_fingerprints(fps: DataFrame, distance: int = 4, block_rows: int = 2048, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at most ``distance`` bits.

    The links are a spanning forest of each block's links: what they connect is exact, but not every pair is listed, so
    a dense group costs no more rows than it has members. A key with over ``block_rows`` fingerprints is dealt over
    pairs of sub-blocks, which are compared by separate tasks. The number of ``blocks`` follows that of the fingerprints.
    """
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks or blocks_for(fps.count(), distance))).alias("k"))
    hot = keyed.groupBy("k").count().where(F.col("count") > block_rows).select("k", F.ceil(F.col("count") / block_rows).cast("int").alias("n"))
    dealt = keyed.join(small(hot), "k", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.select("fp", "k", "s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t"))
    dealt = dealt.select("fp", "k", "s", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"))
    ready = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return ready.mapInPandas(lambda frames: links_in(frames, distance), "a long, b long")


def _grouped(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component) of all fingerprints in ``prints``."""
    fps = cut(prints.select("fp").distinct())
    linked = cut(components(near_fingerprints(fps, distance)))
    return fps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    fingerprint: 16 hex digits. component_id: the smallest doc_id among the documents whose fingerprints are connected
    by links of at most ``distance`` differing bits. Null and empty texts have fingerprint zero and link like others.
    Repeated rows stay; a null doc_id keeps its row and never is a component_id unless its whole component has none.
    Other columns of the input are left out.
    """
    prints = cut(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    named = cut(least.join(_grouped(prints, distance), "fp"))
    lowest = cut(named.groupBy("component").agg(F.min("least_id").alias("component_id")))
    of = cut(named.join(lowest, "component").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row of ``docs`` (doc_id, text) for each group of SimHash fingerprints; all columns stay.

    It is the one with the smallest doc_id; rows without an id come last, and of rows with equal ids in one group the text
    with the smallest hash stays. Of rows equal in id and text one stays, the first by the JSON form of all columns. Null
    and empty texts are one group. An empty table gives no rows.
    """
    text, id_ = unused(docs, "text"), unused(docs, "id")
    named = docs.withColumns({text: text_key("text"), id_: F.col("doc_id")})
    prints = cut(named.select(F.col(id_).alias("id"), F.col(text).alias("t"), fingerprint(F.col("text"), shingle).alias("fp")).groupBy("id", "t", "fp").agg(F.count("*").alias("n")))
    # both sides of the next join are written, so that Spark can split a component with very many texts
    groups = cut(prints.join(_grouped(prints, distance), "fp"))
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "t")
    best = cut(groups.groupBy("component").agg(F.min(rank).alias("best")))
    judged = cut(groups.join(best, "component").select(F.col("id").alias(f"{id_}_"), F.col("t").alias(f"{text}_"), "n", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("t") == F.col("best.t"))).alias("stays")))
    same = F.col(id_).eqNullSafe(F.col(f"{id_}_")) & (F.col(text) == F.col(f"{text}_"))
    kept = named.join(small(judged.where("not stays").drop("n", "stays")), same, "left_anti")
    repeated = small(judged.where("stays and n > 1").drop("n", "stays"))
    if repeated.limit(1).count():
        row = F.struct(*docs.columns)
        once = kept.join(repeated, same, "left_semi").groupBy(id_, text).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        return kept.join(repeated, same, "left_anti").select(*docs.columns).unionByName(once)
    return kept.select(*docs.columns)


def keep_one_near(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """``keep_one``, and then one row for each group of texts that share four fifths of their five-word shingles.

    Fingerprints within a few bits miss most texts of that similarity, so what SimHash leaves is compared by shingles,
    exactly (``near_texts``); what SimHash removes costs nothing there.
    """
    return keep_one_text(keep_one(docs, distance, shingle))
