"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, as in tests, one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the cluster's checkpoint folder, so that its lineage ends here."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """The frame, written; to be broadcast if it has at most ``most_rows`` rows, else joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most_rows else df


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` inside tasks; it is broadcast, so its size must have a bound."""
    sent, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return get


def text_key(text: str) -> Column:
    """A key of a text's content, of 128 bits, so that different texts don't meet; a null counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(71), value).alias("b"))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str) -> Column:
    """True for the fifth of the rows that no classifier may learn from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_by_id(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, value) of at most ``n`` different ids, picked by their hash.

    Only ids are sorted; the values are then fetched by a broadcast of the picked ids, whose number has a bound. An id
    with several values counts with the first by order; rows without id or value are left out.
    """
    ids = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(n)
    return rows.where(F.col(value).isNotNull()).select(key, value).join(F.broadcast(ids), key).groupBy(key).agg(F.min(value).alias(value))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], most_chars: int = 65_536) -> DataFrame:
    """(text, y) of at most ``per_class[y]`` labelled documents of each class that aren't held out.

    The bound is a parameter of the classifiers, as is ``most_chars``, over which a text isn't learnt from. Ids are picked by their hash, so the pick is the same on each run;
    where an id is labelled twice the higher label counts, and where it has many texts the first text by order counts.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*per_class) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    parts = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in per_class.items()]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    # the picked ids have a fixed bound, so they may be broadcast
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= most_chars).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def train_in_task(sample: DataFrame, fit) -> bytes:
    """What ``fit(pandas frame)`` returns, run in one task over a sample of bounded size."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if rows:
            yield pd.DataFrame({"model": [fit(pd.concat(rows, ignore_index=True).sort_values("doc_id", ignore_index=True))]})

    made = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return bytes(made[0][0]) if made else fit(sample.limit(0).toPandas())  # nothing to learn from


def whole_groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows sorted by the keys, cut so that no group is spread over two frames."""
    rest: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        last = f[keys].iloc[-1]
        change = np.flatnonzero((f[keys] != last).any(axis=1).to_numpy())
        if not len(change):
            if rest and (rest[-1][keys].iloc[-1] != last).any():
                yield pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(f)
            continue
        at = change[-1] + 1
        rest.append(f.iloc[:at])
        yield pd.concat(rest, ignore_index=True)
        rest = [f.iloc[at:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
