"""Product codes of vectors in whole numbers: distances by Walsh-Hadamard coefficients, entries given up early.

A part and an entry, padded with zeros to a power of two P, are transformed by the Walsh-Hadamard matrix in the order of
sequency. The squared distance is the sum of the squared differences of their coefficients, divided by P; every partial sum
bounds it from below, so an entry whose partial sum exceeds the whole distance of another one is out. Nothing is rounded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut, shared, unused


def walsh(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def transformed(x: np.ndarray) -> np.ndarray:
    """The coefficients (..., P) of whole numbers (..., n), by sequency; P is the next power of two."""
    size = 1 << max(x.shape[-1] - 1, 0).bit_length()
    return x @ walsh(size)[:, : x.shape[-1]].T


def largest(part: int) -> int:
    """The largest whole component of parts of this length, so that no sum of squares leaves 64 bits."""
    return math.isqrt((1 << 62) // (4 * (1 << max(part - 1, 0).bit_length()) ** 3))


def nearest(x: np.ndarray, entries: np.ndarray, strip: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row, both given by their coefficients; ties to the lower index."""
    index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    size = x.shape[1]
    for at in range(0, len(x), strip):
        some = x[at : at + strip]
        partial = (some[:, :1] - entries[None, :, 0]) ** 2
        guess = partial.argmin(axis=1)
        bound = ((some - entries[guess]) ** 2).sum(axis=1)  # a whole distance, so no entry above it can win
        row, entry = np.nonzero(partial <= bound[:, None])
        total = partial[row, entry]
        for k in range(1, size):
            total += (some[row, k] - entries[entry, k]) ** 2
            stays = total <= bound[row]
            row, entry, total = row[stays], entry[stays], total[stays]
        # rows come in order, and a row's entries by index
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(total, first)
        won = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[first, len(row)])))
        won = won[np.r_[True, row[won][1:] != row[won][:-1]]]
        index[at : at + strip], distance[at : at + strip] = entry[won], least // size
    return index, distance


def usable(v: Column) -> Column:
    """True for vectors that hold no null or non-finite component."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ok, F.lit(False))


def whole_parts(vectors: Iterable, parts: int, part: int, scale: int) -> np.ndarray:
    """(n, parts, part): floored components of vectors, short ones padded with zeros, in the bounds of ``largest``."""
    out = np.zeros((len(vectors), parts * part))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    most = largest(part)
    return np.clip(np.floor(out * scale), -most, most).astype(np.int64).reshape(len(vectors), parts, part)


class Codebooks:
    """The entries of each part position, as whole components (parts, entries, part) and as coefficients."""

    def __init__(self, entries: np.ndarray, scale: int):
        self.entries, self.scale, self.coefficients = entries, scale, transformed(entries)

    def whole(self, vectors: Iterable) -> np.ndarray:
        parts, _, part = self.entries.shape
        return whole_parts(vectors, parts, part, self.scale)

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part (n, parts)."""
        z = transformed(x)
        each = [nearest(z[:, p], c) for p, c in enumerate(self.coefficients)]
        return np.stack([i for i, _ in each], axis=1), np.stack([d for _, d in each], axis=1)

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one round: each entry becomes the floored mean of the parts nearest to it; unused ones stay.

    Each task sends one row for each entry that it has used, so what is shuffled and collected doesn't grow with the rows.
    """
    held = shared(vectors.sparkSession, books)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = held()
        parts, entries, part = b.entries.shape
        sums, counts = np.zeros((parts, entries, part), np.int64), np.zeros((parts, entries), np.int64)
        for f in frames:
            if len(f):
                x = b.whole(f["embedding"])
                index, _ = b.assigned(x)
                for p in range(parts):
                    np.add.at(sums[p], index[:, p], x[:, p])
                    counts[p] += np.bincount(index[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        at = np.arange(part)
        yield pd.DataFrame({"part": np.repeat(p, part), "entry": np.repeat(e, part), "at": np.tile(at, len(p)), "total": sums[p, e].ravel(), "n": np.repeat(counts[p, e], part)})

    told = vectors.select("embedding").mapInPandas(run, "part int, entry int, at int, total long, n long")
    told = told.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    entries = books.entries.copy()
    for r in told.collect():  # one row for each component of the codebooks
        entries[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return Codebooks(entries, books.scale)


def trained_codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks that begin as the parts of the ``entries`` smallest vec_ids of usable ``vectors`` (vec_id, embedding), and
    are improved by ``rounds`` passes over all vectors. Equal ids come by their vectors, a null id last."""
    longest = vectors.agg(F.max(F.size("embedding"))).collect()[0][0] or 0
    part = max(-(-longest // parts), 1)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    books = Codebooks(whole_parts([r[0] for r in first], parts, part, scale).transpose(1, 0, 2), scale)
    for _ in range(rounds if first else 0):
        books = improved(vectors, books)
    return books


def coded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Adds code (two hex digits a part) and error (squared distances summed over parts) to usable ``vectors`` (embedding)."""
    base = vectors.drop("code", "error")
    held, got = shared(vectors.sparkSession, books), unused(base, "got")

    @F.pandas_udf("code string, error long")
    def code(embedding: pd.Series) -> pd.DataFrame:
        b = held()
        if not len(embedding):
            return pd.DataFrame({"code": pd.Series(dtype=object), "error": pd.Series(dtype="int64")})
        index, distance = b.assigned(b.whole(embedding))
        return pd.DataFrame({"code": [row.tobytes().hex() for row in index.astype(np.uint8)], "error": distance.sum(axis=1)})

    return base.withColumn(got, code("embedding")).select(*base.columns, f"{got}.code", f"{got}.error")


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, most_broadcast: int = 100_000) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every usable row of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null, or holds a null or non-finite component, are left out. Each component x counts as
    floor(``scale`` * x). Vectors are cut into ``parts`` equal parts; those shorter than the longest, or than a multiple of
    ``parts``, are padded with zeros, so an empty vector is zero. Components beyond ``largest`` of the part's length (2^27
    for four) count as that, so that all distances stay exact in 64 bits. Ties go to the entry of lower index. With fewer
    rows than ``entries`` (256 at most) the codebooks have as many entries as there are rows. label_error: error summed over
    equal labels of any type, nulls together. Repeated rows stay; an empty table gives no rows; other columns are left out.

    The vectors are read once a round and once for the codes; the codebooks have a fixed size.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    live = vectors.where(usable(F.col("embedding"))).select("vec_id", "embedding", "label")
    books = trained_codebooks(live, parts, entries, rounds, scale)
    rows = cut(coded(live, books).drop("embedding"))
    sums = cut(rows.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= most_broadcast else sums
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
