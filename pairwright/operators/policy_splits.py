"""Splits and gates of the benchmark policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(seed: int, key: str) -> Column:
    """A seeded order of ids that any engine can repeat."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def split_by_group(rows: DataFrame, group: str, strata: list[str], shares: tuple[tuple[str, float], ...] = (("calibration", 0.6), ("validation", 0.2), ("holdout", 0.2)), seed: int = 42) -> DataFrame:
    """Adds split; all rows of a group go to one split, and each stratum is cut by the shares.

    Groups, not rows, are ranked: by a seeded hash within their stratum, which is the least of their rows' values. A rank is
    that in one of 4,096 ranges of the hash, plus what the ranges before it hold, so no task sorts a whole stratum.
    """
    named = rows.groupBy(group).agg(F.to_json(F.struct(*(F.min(s).alias(s) for s in strata))).alias("stratum")).withColumn("place", place(seed, group))
    groups = named.withColumn("range", F.substring("place", 1, 3))
    counts = groups.groupBy("stratum", "range").agg(F.count("*").alias("n"))
    all_ = Window.partitionBy("stratum")
    before = F.coalesce(F.sum("n").over(all_.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.join(counts.select("stratum", "range", before.alias("before"), F.sum("n").over(all_).alias("total")), ["stratum", "range"])
    rank = (F.col("before") + F.row_number().over(Window.partitionBy("stratum", "range").orderBy("place", group)) - 0.5) / F.col("total")
    split = F.lit(shares[-1][0])
    for k in range(len(shares) - 2, -1, -1):
        split = F.when(rank <= sum(share for _, share in shares[: k + 1]), shares[k][0]).otherwise(split)
    return rows.join(groups.select(group, split.alias("split")), group)


def fit_balance(rows: DataFrame, level: str = "fit_level") -> DataFrame:
    """(split, level, n, share): each split's rows by level, and their share of the split; no level counts as unlabeled."""
    counts = rows.groupBy("split", F.coalesce(level, F.lit("unlabeled")).alias(level)).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def balanced_pick(rows: DataFrame, per_level: dict[str, int], key: str = "trace_id", level: str = "fit_level", seed: int = 42) -> DataFrame:
    """So many rows of each level, of lowest seeded hash."""
    quota = F.element_at(F.create_map(*(F.lit(x) for kv in per_level.items() for x in kv)), F.col(level))
    w = Window.partitionBy(level).orderBy(place(seed, key), key)
    return rows.where(F.col(level).isin(*per_level)).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= max(per_level.values())).where(F.col("pick") <= quota)


def policy_pick(rows: DataFrame, group: str, n_groups: int = 50, each: int = 5, key: str = "trace_id", seed: int = 42) -> DataFrame:
    """``each`` rows of each of ``n_groups`` groups that have as many: the policy's final set of 250 pairs of 50 jobs.

    Groups and rows are taken by lowest seeded hash; with fewer such groups, all of them are. Few groups are picked, so the
    rows are filtered by a broadcast of their names before any is ranked.
    """
    sizes = rows.groupBy(group).count().where(F.col("count") >= each)
    chosen = sizes.orderBy(place(seed, group), group).limit(n_groups).select(group)
    w = Window.partitionBy(group).orderBy(place(seed, key), key)
    return rows.join(F.broadcast(chosen), group, "left_semi").withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= each)


def pick_report(picked: DataFrame, group: str, n_groups: int = 50, each: int = 5) -> DataFrame:
    """One row: rows, groups, the least rows of a group, and whether the policy's minimum is met."""
    sizes = picked.groupBy(group).agg(F.count("*").alias("c"))
    out = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_jobs"), F.min("c").alias("least_per_job"))
    return out.withColumn("passed", (F.col("n") >= n_groups * each) & (F.col("n_jobs") >= n_groups))


def freeze_gate(first: DataFrame, second: DataFrame, fields: list[str], least: float = 0.80) -> DataFrame:
    """One row: agreement of two label sets (trace_id, label), missing fields of the first, unresolved ids, and passed."""
    both = first.select("trace_id", F.col("label").alias("a"), *fields).join(second.select("trace_id", F.col("label").alias("b")), "trace_id", "left")
    missing = sum((F.when(F.col(f).isNull(), 1).otherwise(0) for f in fields[1:]), F.when(F.col(fields[0]).isNull(), 1).otherwise(0))
    out = both.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), F.sum(missing).alias("missing_fields"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unresolved"))
    return out.withColumn("passed", F.coalesce((F.col("agreement") >= least) & (F.col("missing_fields") == 0) & (F.col("unresolved") == 0), F.lit(False)))


def shared_templates(rows: DataFrame, template: str = "resume_template", holdout: str = "holdout") -> DataFrame:
    """Templates that the holdout shares with other splits; none if it is independent."""
    held = rows.where(F.col("split") == holdout).select(template).distinct()
    return held.join(rows.where(F.col("split") != holdout).select(template).distinct(), template, "left_semi")
