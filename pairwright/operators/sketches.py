"""Percentiles from KLL sketches: kept for each run, merged over runs, and made exact by one more scan between their bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.sources.records import settled


def rank_error(size: int) -> float:
    """What a sketch of this size errs in rank at most, as a share of the values, with a confidence of 99 %."""
    return 2.296 / size**0.9723


def sketched(rows: DataFrame, keys: list[str], value: str, size: int = 4096) -> DataFrame:
    """(keys, n, total, most, sketch) of the values that are numbers: what a run keeps of its measurements.

    One scan with partial sketches; a sketch holds some three times ``size`` numbers at most, whatever the rows.
    """
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))


def merged(kept: DataFrame, keys: list[str]) -> DataFrame:
    """The same of several runs' rows, by fewer keys."""
    return kept.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))


def at_ranks(sketch: str, shares: list[float]) -> Column:
    """The values at these shares of the ranks, at most the sketch's error off; exact for 0 and 1."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit(min(max(p, 0.0), 1.0)) for p in shares)))


def few(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Written; broadcast if it has so few rows, else joined by a shuffle."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= most_rows else df


def exact_at(rows: DataFrame, sketches: DataFrame, shares: tuple[float, ...], error: float, bins: int = 1024) -> DataFrame:
    """(k, n, p): exact percentiles of ``rows`` (k, v) by linear interpolation; ``sketches`` (k, n, sketch) are of the same rows.

    One scan: values beyond a rank's bounds are counted, those between are counted by value. Only the bins in which the ranks
    lie are sorted. Where a sketch errs by more than ``error`` that rank is sought again between wider bounds.
    """
    each = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("rank")) for i, p in enumerate(shares)))
    open_ = sketches.select("k", "n", "sketch", F.explode(each).alias("w")).select("k", "n", "sketch", "w.*")
    done = None
    while True:
        bounds = {name: F.get(at_ranks("sketch", [p + by for p in shares]), F.col("i")) for name, by in (("low", -error), ("high", error))}
        wanted = few(open_.withColumns(bounds))
        side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
        met = rows.join(wanted.select("k", "i", "low", "high"), "k").select("k", "i", side.alias("side"), "v", "low", "high")
        bin_ = F.when((F.col("side") == 0) & (F.col("low") < F.col("high")), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins)).otherwise(0)
        counted = settled(met.groupBy("k", "i", "side", bin_.alias("bin"), F.when(F.col("side") == 0, F.col("v")).alias("x")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most")))
        outside = counted.groupBy("k", "i").agg(
            F.coalesce(F.sum(F.when(F.col("side") == -1, F.col("c"))), F.lit(0)).alias("below"), F.max(F.when(F.col("side") == -1, F.col("most"))).alias("before"),
            F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("c"))), F.lit(0)).alias("inside"), F.min(F.when(F.col("side") == 1, F.col("least"))).alias("after"),
        )
        known = few(wanted.join(outside, ["k", "i"]))
        fits = (F.floor("rank") >= F.col("below") - 1) & (F.ceil("rank") <= F.col("below") + F.col("inside"))
        # a running count over at most ``bins`` rows a rank, and then over the values of the bins that hold it
        of_bins = counted.where("side = 0").groupBy("k", "i", "bin").agg(F.sum("c").alias("c"))
        order = Window.partitionBy("k", "i").orderBy("bin")
        reached = of_bins.join(known.where(fits).select("k", "i", "rank", "below"), ["k", "i"]).withColumn("upto", F.col("below") + F.sum("c").over(order))
        held = few(reached.where((F.col("upto") > F.floor("rank")) & (F.col("upto") - F.col("c") <= F.ceil("rank"))).select("k", "i", "bin", "rank", (F.col("upto") - F.col("c")).alias("start")))
        inner = counted.where("side = 0").join(held, ["k", "i", "bin"]).withColumn("upto", F.col("start") + F.sum("c").over(Window.partitionBy("k", "i", "bin").orderBy("x")))
        at = lambda r: F.min(F.when(F.col("upto") > r, F.col("x")))
        found = inner.groupBy("k", "i").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
        low = F.when(F.floor("rank") < F.col("below"), F.col("before")).otherwise(F.coalesce("a", "after"))
        high = F.when(F.ceil("rank") < F.col("below"), F.col("before")).otherwise(F.coalesce("b", "after"))
        got = settled(known.where(fits).join(found, ["k", "i"], "left").select("k", "n", "i", (low + (high - low) * (F.col("rank") - F.floor("rank"))).alias("p")))
        done = got if done is None else done.unionByName(got)
        open_ = known.where(~fits).select("k", "n", "sketch", "i", "rank")
        if error >= 1 or open_.limit(1).count() == 0:
            break
        error *= 8
    return done.groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("p")).select("k", "n", F.transform("p", lambda x: x["p"]).alias("p"))
