"""Benchmark decontamination: a prefix-filtered containment join of item windows with document words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut, shared, small, text_key, unused

#: Words are runs of digits, letters and what lies beyond ASCII; bytes of such characters are all above 0x7F.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
IS_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in LOWER])
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE, PIECE = 0x100000001B3, 1 << 16  # bytes of text whose running sums a task holds at once
POWERS = np.cumprod(np.array([1] + [BASE] * (PIECE - 1), np.uint64), dtype=np.uint64)
INVERSES = np.cumprod(np.array([1] + [pow(BASE, -1, 1 << 64)] * (PIECE - 1), np.uint64), dtype=np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; a null has none."""
    return WORD.findall((text or b"").lower())


class Words(NamedTuple):
    """The words of some texts, one after the other: their hashes, where they lie in ``joined``, and in which text."""

    joined: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @classmethod
    def read(cls, texts: list[bytes]) -> Words:
        """A word's hash is a polynomial of its bytes, got from running sums over pieces of fixed size."""
        joined = b"\0".join(texts)
        hashes, starts, ends, begun, total = [], [], [], None, np.uint64(0)
        for at in range(0, len(joined), PIECE):
            low = LOWER[np.frombuffer(joined, np.uint8, min(PIECE, len(joined) - at), at)]
            step = np.diff(np.concatenate([[begun is not None], IS_WORD[low]]).astype(np.int8))
            up, down = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            # power of the piece's first byte, then of each byte inside it
            sums = np.concatenate([[total], total + np.cumsum((low.astype(np.uint64) + np.uint64(1)) * POWERS[: len(low)] * np.uint64(pow(BASE, at, 1 << 64)))])
            first = np.concatenate([[] if begun is None else [begun[0]], up + at]).astype(np.int64)
            before = np.concatenate([np.array([] if begun is None else [begun[1]], np.uint64), sums[up]])
            last_, after = down + at, sums[down]
            if at + PIECE >= len(joined) and len(first) > len(last_):
                last_, after = np.append(last_, len(joined)), np.append(after, sums[-1])
            begun = (first[-1], before[-1]) if len(first) > len(last_) else None
            first, before = first[: len(last_)], before[: len(last_)]
            back = np.array([pow(BASE, -int(p) * PIECE, 1 << 64) for p in np.unique(first // PIECE)], np.uint64)
            scale = back[np.searchsorted(np.unique(first // PIECE), first // PIECE)] * INVERSES[first % PIECE]
            hashes.append((after - before) * scale)
            starts.append(first)
            ends.append(last_)
            total = sums[-1]
        none = np.empty(0, np.int64)
        starts_ = np.concatenate([none, *starts])
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
        return cls(joined, np.concatenate([np.empty(0, np.uint64), *hashes]), starts_, np.concatenate([none, *ends]), np.searchsorted(begins, starts_, side="right") - 1)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word with the next one of its text (zero if there is none), and of each word by itself."""
        one = (self.hashes ^ (self.hashes >> np.uint64(29))) * MIX
        two = np.zeros(len(one), np.uint64)
        two[:-1] = np.where(self.of[1:] == self.of[:-1], (one[:-1] ^ (one[1:] << np.uint64(1)) ^ (one[1:] >> np.uint64(31))) * MIX, 0)
        return (two ^ (two >> np.uint64(30))).view(np.int64), (one * MIX ^ (one >> np.uint64(31))).view(np.int64)


def groups_of(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of together some ``most`` bytes, with the place of the first."""
    some, size, first = [], 0, 0
    for k, t in enumerate(texts):
        if some and size + len(t) > most:
            yield first, some
            some, size, first = [], 0, k
        some.append(t)
        size += len(t)
    if some:
        yield first, some


def texts_in(batch: pa.RecordBatch, rows: int = 256) -> Iterator[bytes]:
    """The batch's texts, of which a few are copied out of it at a time."""
    for at in range(0, len(batch), rows):
        yield from batch.column("text").slice(at, rows).to_pylist()


def n_words(text: Column) -> Column:
    """The number of words of a text; a null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words, size, shingles) of each item's windows: ``window`` words each, or all of a shorter item."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for item, text in zip(f["item_id"], f["text"], strict=True):
                words = words_of(text)
                if not words:
                    continue
                size = min(window, len(words))
                two, one = Words.read([text]).shingles()
                starts = range(len(words) - size + 1)
                for at in range(0, len(starts), 10_000):
                    some = starts[at : at + 10_000]
                    yield pd.DataFrame({"item_id": [item] * len(some), "words": [b" ".join(words[s : s + size]) for s in some], "size": size, "shingles": [(one if size == 1 else two[s : s + size - 1]) for s in some]})

    schema = f"item_id {dict(items.dtypes)['item_id']}, words binary, size int, shingles array<long>"
    return items.select("item_id", "text").mapInPandas(run, schema)


def sieve(hashes: DataFrame, most_bits: int = 26) -> Callable[[np.ndarray], np.ndarray]:
    """For use in tasks: which of an array's hashes may be among the frame's (column h, written); those that it denies are not.

    It is a bitmap of a hash's first bits, some 64 places for each of the frame's hashes, but no more than ``most_bits`` bits (8
    MB): with more hashes it lets more through, and joins drop that. It reaches the driver as at most 2 ** 20 rows.
    """
    bits = min(most_bits, max(16, (64 * hashes.count()).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    made = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("marks")).toArrow()
    held = np.zeros(1 << (bits - 6), np.int64)
    held[made["at"].to_numpy()] = made["marks"].to_numpy()
    sent = shared(hashes.sparkSession, held.view(np.uint64))

    def holds(h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) >> np.uint64(64 - bits)
        return (sent()[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    return holds


def shingle_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(h, n): how often the shingles of ``known`` (column h) occur in all of ``docs.text``; those that don't are left out."""
    may = sieve(known)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in groups_of(texts_in(batch)):
                h, n = np.unique(np.concatenate([h[(h != 0) & may(h)] for h in Words.read(some).shingles()]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": h, "n": n})
            del batch  # before the next one is read

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counted.join(known, "h", "left_semi")


def candidates(docs: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """(t, h, before, around): where the shingle h of ``prefixes`` (h) may stand in a text (t, text), with the words around.

    around: up to ``window`` - 1 words before and behind it, space-joined; before: how many of them come first.
    """
    may = sieve(prefixes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column("t").field(k) for k in "ab")
            for first, some in groups_of(texts_in(batch)):
                words = Words.read(some)
                edges = np.searchsorted(words.of, np.arange(len(some) + 1))  # each text's first word
                for h in words.shingles():
                    hits = np.flatnonzero((h != 0) & may(h))
                    for k in range(0, len(hits), 5_000):
                        at = hits[k : k + 5_000]
                        of = words.of[at]
                        low, high = np.maximum(at - window + 1, edges[of]), np.minimum(at + window, edges[of + 1] - 1)
                        around = [b" ".join(words_of(words.joined[i:j])) for i, j in zip(words.starts[low], words.ends[high], strict=True)]
                        t = pa.StructArray.from_arrays([x.take(pa.array(first + of)) for x in (a, b)], ["a", "b"])
                        yield pa.RecordBatch.from_pydict({"t": t, "at": (at - edges[of]).astype(np.int32), "h": h[at], "before": (at - low).astype(np.int32), "around": pa.array(around, pa.binary())})
            del batch, a, b  # before the next one is read

    schema = "t struct<a: bigint, b: bigint>, at int, h long, before int, around binary"
    return docs.mapInArrow(run, schema)


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Adds n_words, n_hit, n_items, item_ids and contaminated to every row of ``docs`` (text).

    A window is ``window`` consecutive words of an item, or all of a shorter one. A word inside any occurrence of a
    window is hit; item_ids are the items with occurring windows, sorted as strings. Null and empty texts have no words
    and nothing hit; null, empty and repeated items are allowed, an item without an id hits words but isn't listed. No
    items: nothing is hit. Rows are kept as they are, and equal texts have equal results; other columns stay, and those
    of these names are replaced.

    A window is contained whole or not at all, so its prefix in the order of rarity is one shingle, a pair of neighbouring
    words (or the word of a one-word window): the one that occurs least in all documents, ties by hash. A window with a
    shingle that never occurs is left out. Texts are read three times, whatever the benchmark's size: to count shingles,
    to find the prefixes, and for the result. Tasks hold a bitmap of bounded size; the windows are joined with the places found, where length
    and position are compared before the words are.
    """
    new = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    base = docs.drop(*new)
    # windows are told apart by their words; the items of each are kept aside
    each = cut(windows_of(benchmark.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text")), window))
    distinct = cut(each.select("words", "size", "shingles").dropDuplicates(["words"]))
    texts = docs.where("text is not null").select(text_key("text").alias("t"), F.col("text").cast("binary").alias("text"))
    counts = small(shingle_counts(texts, cut(distinct.select(F.explode("shingles").alias("h")).distinct())))
    # rarest first; a window of which not all shingles are counted can't occur
    placed = distinct.select("words", "size", F.posexplode("shingles").alias("offset", "h")).join(counts, "h", "left")
    rarest = placed.groupBy("words", "size").agg(F.min_by(F.struct("h", "offset"), F.struct("n", "h", "offset")).alias("x"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    prefixes = cut(rarest.where("all").select("words", "size", "x.h", "x.offset"))
    known = cut(prefixes.select("h").distinct())
    # what the bitmap lets through by chance goes before anything is shuffled, where the hashes are few enough to be broadcast
    found = cut(candidates(texts, known, window).join(small(known), "h", "left_semi").distinct())
    # length and position first, then the words themselves
    start = F.col("before") - F.col("offset")
    met = found.join(small(prefixes), "h").withColumn("near", F.split(F.col("around").cast("string"), " "))
    met = met.where((start >= 0) & (start + F.col("size") <= F.size("near")))
    met = met.where(F.array_join(F.slice("near", start + 1, F.col("size")), " ") == F.col("words").cast("string"))
    hits = cut(met.select("t", (F.col("at") - F.col("offset")).alias("start"), "size", "words").distinct())
    listed = hits.select("t", "words").distinct().join(small(each.select("words", "item_id").where("item_id is not null").distinct()), "words")
    items = listed.groupBy("t").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    # the starts of one text, each with its longest window: a word is hit once, by the first window that reaches it
    longest = hits.groupBy("t", "start").agg(F.max("size").alias("size"))
    runs = longest.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("s"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))
    n_hit = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))
    key, got = unused(docs, "key"), unused(docs, "got")
    per_text = small(runs.select("t", n_hit.alias("n")).join(items, "t", "left").select(F.col("t").alias(key), F.struct("n", "ids").alias(got)))
    out = base.withColumn(key, text_key("text")).join(per_text, key, "left")
    ids = F.coalesce(f"{got}.ids", F.array().cast("array<string>"))
    out = out.withColumns({"n_words": n_words(F.col("text")), "n_hit": F.coalesce(f"{got}.n", F.lit(0)).cast("long"), "n_items": F.size(ids).cast("long"), "item_ids": ids})
    return out.withColumn("contaminated", F.col("n_hit") > 0).select(*base.columns, *new)


def items_digest(item_ids: Column) -> Column:
    """Lowercase hex SHA-256 of the ids, comma-joined."""
    return F.sha2(F.array_join(item_ids, ","), 256)
