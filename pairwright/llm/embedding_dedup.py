"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut, local_components, shared, small, whole_groups
from pairwright.llm.components import components


def usable(v: Column) -> Column:
    """True for vectors without null or non-finite components that aren't zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: pd.Series) -> np.ndarray:
    """Unit vectors; each is scaled by its largest component first, so that no square over- or underflows."""
    x = np.stack(vectors.to_list()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def label_key(vectors: DataFrame, label: str = "label") -> Column:
    """A label of any type as text; equal labels have equal texts (0.0 and -0.0 are equal)."""
    plain = F.col(label) + F.lit(0) if dict(vectors.dtypes)[label] in ("float", "double") else F.col(label)
    return plain.cast("string") if dict(vectors.dtypes)[label].split("<")[0] not in ("array", "struct", "map") else F.to_json(F.struct(F.col(label)))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11, strip: int = 1024) -> np.ndarray:
    """k unit centroids of unit vectors; an empty cell takes a vector that fits its own cell worst.

    Products are made for ``strip`` vectors at a time, so what is held is the vectors and strip times k numbers.
    """
    g = np.random.default_rng(seed)
    c = x[g.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        cell, fit = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), strip):
            near = x[at : at + strip] @ c.T
            cell[at : at + strip], fit[at : at + strip] = near.argmax(axis=1), near.max(axis=1)
        c = np.zeros_like(c)
        np.add.at(c, cell, x)
        norm = np.linalg.norm(c, axis=1)
        worst = np.argsort(fit)[: (norm < 1e-9).sum()]
        c[np.flatnonzero(norm < 1e-9)[: len(worst)]] = x[worst]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def cells_of(n: int, cell_rows: int, few_rows: int = 24, few_cells: int = 4) -> int:
    """Into how many cells n vectors are cut: one for each ``cell_rows``, but up to ``few_cells`` from so many ``few_rows`` on.

    In few vectors more cells save little, as most have neighbours in several; in many, cells of a fixed size keep the work
    in proportion.
    """
    return max(-(-n // cell_rows), min(few_cells, n // few_rows), 1)


def fit_cells(distinct: DataFrame, cell_rows: int, sample_each: int, most_cells: int) -> dict[tuple[str, int], np.ndarray]:
    """Centroids by (label, dimension) where a label has vectors for two cells (``cells_of``); at most ``most_cells`` in all.

    They are fitted on about ``sample_each`` vectors a cell, picked by hash, one task for each label.
    """
    sizes = distinct.groupBy("label", F.size("embedding").alias("dim")).count().where(F.col("count") > min(cell_rows, 47))
    rows = [r for r in sizes.orderBy(F.desc("count"), "label", "dim").limit(most_cells // 2).collect() if cells_of(r["count"], cell_rows) > 1]
    if not rows:
        return {}
    scale = min(1.0, most_cells / sum(cells_of(r["count"], cell_rows) for r in rows))
    plan = [(r["label"], r["dim"], max(2, int(cells_of(r["count"], cell_rows) * scale)), r["count"]) for r in rows]
    wanted = distinct.sparkSession.createDataFrame([(a, b, k, min(1.0, sample_each * k / n)) for a, b, k, n in plan], "label string, dim int, k int, part double")
    picked = distinct.withColumn("dim", F.size("embedding")).join(F.broadcast(wanted), ["label", "dim"]).where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_003)) < F.col("part") * 1_000_003)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        c = spherical_kmeans(unit(rows.sort_values("rid")["embedding"]), int(rows["k"].iloc[0]))
        return pd.DataFrame({"label": rows["label"].iloc[0], "dim": rows["dim"].iloc[0], "centroid": list(c)})

    out: dict[tuple[str, int], list] = {}
    for r in picked.groupBy("label", "dim").applyInPandas(fit, "label string, dim int, centroid array<double>").collect():
        out.setdefault((r[0], r[1]), []).append(r[2])
    return {k: np.array(v) for k, v in out.items()}


def cells(distinct: DataFrame, centroids: dict[tuple[str, int], np.ndarray], threshold: float) -> DataFrame:
    """(label, dim, cell, host, rid, n, embedding): each vector in its nearest cell as host, and as guest in every cell
    where a vector within the threshold could live.

    If x has centroid c and y has d and |x - y| <= r, then x.(c - d) <= r |c - d|, as y.(c - d) <= 0; so these cells
    hold all neighbours, and no link is lost at a border.
    """
    held, reach = shared(distinct.sparkSession, centroids), np.sqrt(2 - 2 * threshold) + 1e-9
    between: dict[tuple[str, int], np.ndarray] = {}

    def apart(key: tuple[str, int], c: np.ndarray) -> np.ndarray:
        """How far each centroid is from each, once a worker; rounded up, so that no neighbour is missed."""
        if key not in between:
            between[key] = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)).astype(np.float32) + np.float32(1e-5)
        return between[key]

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["dim"] = f["embedding"].map(len)
            for key, part in f.groupby(["label", "dim"], sort=False):
                c = held().get((key[0], int(key[1])))
                if c is None:
                    yield part.assign(cell=0, host=True)
                    continue
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    near = unit(some["embedding"]) @ c.T
                    own = near.argmax(axis=1)
                    gap = near[np.arange(len(some)), own][:, None] - near
                    row, cell = np.nonzero(gap <= reach * apart((key[0], int(key[1])), c)[own] + 1e-9)
                    yield some.iloc[row].assign(cell=cell, host=cell == own[row])

    schema = "label string, dim int, cell int, host boolean, rid long, n long, embedding " + dict(distinct.dtypes)["embedding"]
    return distinct.select("label", "embedding", "n", "rid").mapInPandas(lambda frames: (f[["label", "dim", "cell", "host", "rid", "n", "embedding"]] for f in place(frames)), schema)


def compare(frames: Iterable[pd.DataFrame], threshold: float, strip: int = 512) -> Iterator[pd.DataFrame]:
    """For frames sorted by (label, dim, cell, i, j): each row's links and its parent in a spanning forest of them."""
    keys = ["label", "dim", "cell", "i", "j"]
    for f in whole_groups(frames, keys):
        for key, g in f.groupby(keys, sort=False):
            x, copies, host, side = unit(g["embedding"]), g["n"].to_numpy(), g["host"].to_numpy(), g["s"].to_numpy()
            links, label = np.zeros(len(g), np.int64), np.arange(len(g))
            for at in range(0, len(g), strip):
                near = x[at : at + strip] @ x.T >= threshold
                near[np.arange(near.shape[0]), np.arange(at, at + near.shape[0])] = False
                near &= host[at : at + strip, None] | host[None]
                if key[3] != key[4]:
                    near &= side[at : at + strip, None] != side[None]
                links[at : at + strip] += near @ copies
                a, b = np.nonzero(near)
                label = local_components(len(g), np.concatenate([np.arange(len(g)), a + at]), np.concatenate([label, b]))
            rid = g["rid"].to_numpy()
            links[~host] = 0
            told = (links > 0) | (label != np.arange(len(g)))
            yield pd.DataFrame({"rid": rid[told], "links": links[told], "parent": rid[label[told]]})


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 2000, block_rows: int = 4096, sample_each: int = 20, most_cells: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Labels may be of any type. Vectors link if their labels are equal and not null, and their cosine is at least ``threshold``. n_links: other rows
    linked directly; component_id: smallest vec_id reachable, itself included; kept: vec_id is component_id. Vectors that
    are null, empty, zero, or hold null or non-finite components, and those of null label, link with nothing; vectors
    of different lengths don't link. Equal vectors are compared once and counted as often as they occur. Repeated rows
    stay; a row without a vec_id has links but isn't kept. Other columns are left out.

    The centroids come from a bounded sample, labels of 48 vectors on have some; every vector is placed. Large cells are dealt over pairs of sub-blocks.
    """
    rows = vectors.select("vec_id", "embedding", F.when(usable(F.col("embedding")), label_key(vectors)).alias("label"))
    live = rows.where("label is not null")
    distinct = cut(live.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n")))
    distinct = cut(distinct.withColumn("rid", F.monotonically_increasing_id()))
    placed = cells(distinct, fit_cells(distinct, cell_rows, sample_each, most_cells), threshold)
    key = ["label", "dim", "cell"]
    hot = small(placed.groupBy(*key).count().where(F.col("count") > block_rows).select(*key, F.ceil(F.col("count") / block_rows).cast("int").alias("parts")))
    dealt = placed.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("s", "t"), "j": F.greatest("s", "t")}).drop("parts", "t")
    ready = dealt.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    found = cut(ready.mapInPandas(lambda frames: compare(frames, threshold), "rid long, links long, parent long"))
    linked = cut(components(found.select(F.col("rid").alias("a"), F.col("parent").alias("b"))))
    links = cut(found.groupBy("rid").agg(F.sum("links").alias("links")))
    named = distinct.join(links, "rid", "left").join(linked, F.col("rid") == F.col("node"), "left")
    named = named.select("label", "embedding", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component"))
    lowest = cut(named.groupBy("component").agg(F.min("least_id").alias("component_id")))
    of = cut(named.join(lowest, "component").select("label", "embedding", "n_links", "component_id"))
    out = live.join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
