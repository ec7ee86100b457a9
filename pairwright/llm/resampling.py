"""Importance resampling towards a target: hashed runs of words, counted and scored through an Aho-Corasick dictionary.

A dictionary holds the distinct words of some texts, each bounded by a delimiter on both sides and carrying its CRC-32 and
its length. A scan emits these payloads in the order of the words, and the CRC-32 of a run of words is composed of those of
its words: appending n bytes shifts a checksum by a linear map that depends on n alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import cut, shared, unused

#: A-Z become a-z; what is no digit, letter or part of a character beyond ASCII becomes a blank, the delimiter.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPACE = np.uint32(zlib.crc32(b" "))
LONGEST = 1 << 31  # of a word, in bytes
DIRECT = 64  # lengths with a table of their own


def _linear(columns: np.ndarray) -> np.ndarray:
    """Tables (4, 256) of the linear map that sends bit i to ``columns[i]``; one for each byte of its argument."""
    out = np.zeros((4, 256), np.uint32)
    for part in range(4):
        for bit in range(8):
            out[part] ^= np.where(np.arange(256) >> bit & 1, columns[8 * part + bit], 0).astype(np.uint32)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The map of ``tables`` (..., 4, 256) at each checksum; with leading axes, the map of the same place."""
    parts = [(crc >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64) for k in range(4)]
    if tables.ndim == 2:
        return tables[0][parts[0]] ^ tables[1][parts[1]] ^ tables[2][parts[2]] ^ tables[3][parts[3]]
    raise ValueError("one map at a time")


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps for 0 to ``DIRECT`` appended zero bytes, and for each power of two below ``LONGEST``."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    # a checksum's change by one zero byte, without the constant that crc32 of zero bytes holds
    one = np.array([zlib.crc32(b"\0", int(b)) ^ zlib.crc32(b"\0", 0) for b in bits], np.uint32)
    step = _linear(one)
    direct, columns = [_linear(bits)], bits
    for _ in range(DIRECT):
        columns = _apply(step, columns)
        direct.append(_linear(columns))
    powers, columns = [step], one
    while 1 << len(powers) < LONGEST:
        columns = _apply(powers[-1], columns)
        powers.append(_linear(columns))
    return np.stack(direct), powers


SHIFTS, POWERS = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each checksum after ``n`` zero bytes more, without the constant of those."""
    near, out = np.minimum(n, DIRECT), np.zeros_like(crc)
    for k in range(4):
        out ^= SHIFTS[near, k, (crc >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64)]
    far = np.flatnonzero(n > DIRECT)
    if len(far):
        some, left = out[far], n[far] - DIRECT
        for k, tables in enumerate(POWERS):
            odd = (left >> k & 1).astype(bool)
            some[odd] = _apply(tables, some[odd])
        out[far] = some
    return out


def dictionary(words: Iterable[bytes]) -> ahocorasick.Automaton:
    """An automaton over the distinct words, bounded by blanks; a payload is the length shifted by 32 bits, plus the CRC-32."""
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
    if len(out):
        out.make_automaton()
    return out


def emitted(known: ahocorasick.Automaton, text: bytes) -> np.ndarray:
    """The payloads of a plain text's words in order, as the scan emits them."""
    if not len(known):
        return np.empty(0, np.int64)
    return np.fromiter(map(itemgetter(1), known.iter(f" {text.decode('latin-1')} ")), np.int64)


def run_checksums(payloads: np.ndarray, of: np.ndarray, runs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(CRC-32, text) of all runs of 1 to ``runs`` neighbouring words of one text, words joined by a blank."""
    crc, size = (payloads & 0xFFFFFFFF).astype(np.uint32), payloads >> 32
    out = [(crc, of)]
    for k in range(1, runs):
        before = out[-1][0][: max(len(crc) - k, 0)]  # runs that begin at the first words
        same = of[: len(before)] == of[k:]
        spaced = shifted(before, np.ones(len(before), np.int64)) ^ SPACE
        whole = shifted(spaced, size[k:]) ^ crc[k:]
        out.append((np.where(same, whole, np.uint32(0)), np.where(same, of[k:], -1)))
    return out


def buckets_of(texts: list[bytes | None], buckets: int, runs: int = 2) -> list[bytes]:
    """For each text the buckets of its features, as little-endian numbers of four bytes (two for up to 65,536 buckets)."""
    plain = [(t or b"").translate(PLAIN) for t in texts]
    known = dictionary(set().union(*(p.split() for p in plain)))
    each = [emitted(known, p) for p in plain]
    of = np.repeat(np.arange(len(each)), [len(e) for e in each])
    found = run_checksums(np.concatenate([np.empty(0, np.int64), *each]), of, runs)
    bucket = np.concatenate([(crc % np.uint32(buckets))[at >= 0] for crc, at in found]).astype("<u2" if buckets <= 1 << 16 else "<u4")
    owner = np.concatenate([at[at >= 0] for _, at in found])
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    bucket = bucket[order]
    return [bucket[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def featured(rows: DataFrame, name: str, buckets: int, runs: int, group_bytes: int = 4 << 20) -> DataFrame:
    """Adds ``name``, the buckets of all features of the whole text; a dictionary serves texts of some ``group_bytes``."""

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        out: list[bytes] = []
        some: list[bytes | None] = []
        size = 0
        for t in texts:
            if some and size + len(t or b"") > group_bytes:
                out += buckets_of(some, buckets, runs)
                some, size = [], 0
            some.append(t)
            size += len(t or b"")
        return pd.Series(out + (buckets_of(some, buckets, runs) if some else []), dtype=object)

    return rows.withColumn(name, features(F.col("text").cast("binary")))


def bucket_counts(rows: DataFrame, features: str, buckets: int) -> DataFrame:
    """(bucket, n): how often each bucket occurs among all features; each task sends one row a bucket at most."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(buckets, np.int64)
        for f in frames:
            for b in f[features]:
                seen += np.bincount(np.frombuffer(b, kind), minlength=buckets)
        yield pd.DataFrame({"bucket": np.flatnonzero(seen), "n": seen[seen > 0]})

    return rows.select(features).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Of each bucket, how much likelier the target makes it than the corpus: log ratio of smoothed shares, in thousandths,
    floored. Both are (bucket, n); there are ``buckets`` numbers, whatever the size of the tables."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, counts in ((s, corpus), (t, target)):
        for r in counts.collect():  # at most one row a bucket
            held[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = 10_000, runs: int = 2, seed: int = 7) -> DataFrame:
    """Adds n_features, weight and score to every row of ``docs`` (doc_id, text); ``target`` has text.

    Features are all runs of 1 to ``runs`` words of the whole text, repeats counted, hashed into ``buckets``. weight: the
    floored mean of the gains of a text's features; score: weight plus seeded Gumbel noise of the id, so that the highest
    scores are a draw without replacement by exp(weight / 1000). Null and empty texts have no features and weight 0; a null
    id draws its noise as an empty text would. Without a target or documents all counts are zero. Rows are kept as they are,
    repeated ones have equal scores; other columns stay and those of the three names are replaced.

    Texts are scanned once: what a scan finds is written as two bytes a feature, then counted and scored.
    """
    new = ["n_features", "weight", "score"]
    base = docs.drop(*new)
    name = unused(base, "features")
    rows = cut(featured(base, name, buckets, runs))
    wanted = featured(target.select("text"), "f", buckets, runs)
    held = shared(docs.sparkSession, gains(bucket_counts(rows, name, buckets), bucket_counts(wanted, "f", buckets), buckets))
    width = 2 if buckets <= 1 << 16 else 4

    @F.pandas_udf("long")
    def weight(features: pd.Series) -> pd.Series:
        gain = held()
        return pd.Series([int(gain[np.frombuffer(b, f"<u{width}")].sum()) // (len(b) // width) if b else 0 for b in features], dtype="int64")

    out = rows.withColumns({"n_features": (F.octet_length(name) / width).cast("long"), "weight": weight(name)})
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return out.withColumn("score", F.col("weight") + noise).select(*base.columns, *new)


def drawn(scored: DataFrame, percent: int = 25, least_words: int = 20, runs: int = 2) -> DataFrame:
    """Adds rank to every row of ``scored`` (doc_id, n_features, weight, score): 1, 2, 3... by score for those drawn, else null.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) with the highest scores are drawn; ties go to
    the smaller doc_id, then to fewer features; a null id comes last, and rows equal in all of these follow in any order. Scores are
    whole numbers of a bounded range, so their counts, which say where each score's ranks begin, are few; ids are ordered
    within one score only. ``scored`` is written first: give the columns that are wanted, and the text by a join if need be.
    """
    rank = "rank"
    rows = cut(scored.drop(rank))
    # a text of w words has w + (w - 1) + ... features of up to ``runs`` words
    least = sum(max(least_words - k, 0) for k in range(runs))
    fits = F.col("n_features") >= least
    counts = pd.DataFrame(rows.where(fits).groupBy("score").count().collect(), columns=["score", "n"]).sort_values("score", ascending=False)
    most = percent * int(counts["n"].sum()) // 100
    counts["before"] = counts["n"].cumsum() - counts["n"]
    counts = counts[counts["before"] < most]
    none = F.lit(None).cast("long").alias(rank)
    if not len(counts):
        return rows.select("*", none)
    lowest, at = int(counts["score"].min()), unused(rows, "before")
    begins = rows.sparkSession.createDataFrame(list(zip(counts["score"].tolist(), counts["before"].tolist(), strict=True)), f"score long, {at} long")
    high = fits & (F.col("score") >= lowest)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    ranked = rows.where(high).join(F.broadcast(begins), "score").withColumn(rank, F.col(at) + place)
    ranked = ranked.select(*rows.columns, F.when(F.col(rank) <= most, F.col(rank)).alias(rank))
    return ranked.unionByName(rows.where(~high).select("*", none))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, **options: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that are drawn, with n_features, weight, score and rank; see ``importance_scores``
    and ``drawn``. The texts are written with the scores."""
    return drawn(importance_scores(docs, target, **options), percent, least_words, options.get("runs", 2)).where("rank is not null")
