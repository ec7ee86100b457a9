"""Reports over label rows, measurements and attempts. All are partial aggregates of few groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.operators import sketches as K
from pairwright.sources.records import settled

METRICS = ("skills_overlap", *policy.FLAGS)


def rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def correlations(labels: DataFrame) -> DataFrame:
    """(metric_a, metric_b, r): Pearson matrix of the overlap and the five flags, from one pass of moments.

    0 for fewer than two rows or for a metric without variance; rounded to four places, halves to even.
    """
    values = labels.select(*(F.col(m).cast("double").alias(m) for m in METRICS))
    n = len(METRICS)
    aggs = [F.count("*").alias("n")]
    for i, a in enumerate(METRICS):
        aggs.append(F.stddev_pop(a).alias(f"s{i}"))
        aggs += [F.covar_pop(a, b).alias(f"c{i}_{j}") for j, b in enumerate(METRICS[:i])]
    one = values.agg(*aggs)

    def cell(i: int, j: int) -> Column:
        if i == j:
            return F.when((F.col("n") >= 2) & (F.col(f"s{i}") > 0), 1.0).otherwise(0.0)
        r = F.try_divide(F.col(f"c{max(i, j)}_{min(i, j)}"), F.col(f"s{i}") * F.col(f"s{j}"))
        return F.when(F.col("n") >= 2, F.coalesce(F.bround(r, 4), F.lit(0.0))).otherwise(0.0)

    cells = F.array(*(F.struct(F.lit(METRICS[i]).alias("metric_a"), F.lit(METRICS[j]).alias("metric_b"), cell(i, j).alias("r")) for i in range(n) for j in range(n)))
    return one.select(F.explode(cells).alias("x")).select("x.*")


def breakdown(labels: DataFrame, key: Column, name: str, flags: tuple[str, ...] = policy.FLAGS) -> DataFrame:
    """Per group: count, mean overlap, mean failures and the flags' rates."""
    return labels.groupBy(key.alias(name)).agg(F.count("*").alias("count"), F.avg("skills_overlap").alias("mean_overlap"), F.avg("failure_count").alias("mean_failure_count"), *(rate(f).alias(f"{f}_rate") for f in flags))


def by_fit_level(labels: DataFrame) -> DataFrame:
    return breakdown(labels, F.coalesce("generated_fit_label", F.lit("unlabeled")), "fit_level")


def by_template(labels: DataFrame) -> DataFrame:
    return breakdown(labels, F.col("resume_template"), "resume_template", ("awkward_language", "hallucinated_skills"))


def with_role(labels: DataFrame, niche: DataFrame) -> DataFrame:
    """Labels with role_type from ``niche`` (trace_id, is_niche_role); absent or null is standard."""
    return labels.join(niche.select("trace_id", "is_niche_role"), "trace_id", "left").withColumn("role_type", F.when(F.coalesce("is_niche_role", F.lit(False)), "niche").otherwise("standard")).drop("is_niche_role")


def by_role(labelled: DataFrame) -> DataFrame:
    return breakdown(labelled, F.col("role_type"), "role_type")


def fit_order(level: Column) -> Column:
    """Sort key: levels in policy order, then the unlabelled."""
    place = F.array_position(F.array(*(F.lit(x) for x in (*policy.FIT_LEVELS, "unlabeled"))), level)
    return F.when(place == 0, 99).otherwise(place)


def long_rates(wide: DataFrame, key: str, flags: tuple[str, ...] = policy.FLAGS) -> DataFrame:
    """(key, metric, rate) from columns of rates."""
    return wide.unpivot([key], [f"{f}_rate" for f in flags], "metric", "rate")


def square(long: DataFrame) -> DataFrame:
    """The correlation rows as a square table."""
    return long.groupBy("metric_a").pivot("metric_b", list(METRICS)).agg(F.first("r"))


def flag_summary(labels: DataFrame) -> DataFrame:
    """(flag, n, rate) of all rows, zero for none."""
    sums = labels.agg(F.count("*").alias("n"), *(F.count_if(F.col(f)).alias(f) for f in policy.FLAGS))
    each = F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).alias("n_flagged"), F.coalesce(F.try_divide(F.col(f).cast("double"), F.col("n")), F.lit(0.0)).alias("rate")) for f in policy.FLAGS))
    return sums.select(F.explode(each).alias("x")).select("x.*")


def failure_rates(labels: DataFrame) -> DataFrame:
    """One row of six rates, zero for no rows."""
    return labels.agg(F.count("*").alias("row_count"), *(F.coalesce(rate(f), F.lit(0.0)).alias(f"{f}_rate") for f in (*policy.FLAGS, "requires_human_review")))


def fit_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.coalesce("computed_fit_label", F.lit("unknown")).alias("fit_label")).count()


def judge_summary(judge: DataFrame) -> DataFrame:
    """One row: rows, errors, and rates and mean score over rows without an error (zero if there are none)."""
    fine = F.col("judge_error").isNull()
    mean = lambda c: F.coalesce(F.avg(F.when(fine, c)), F.lit(0.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return judge.agg(
        F.count("*").alias("row_count"), F.count_if(~fine).alias("judge_error_count"), mean(flag(F.col("has_hallucinations"))).alias("hallucination_rate"), mean(flag(F.col("has_awkward_language"))).alias("awkward_language_rate"),
        mean(F.col("overall_quality_score")).alias("mean_overall_quality_score"), mean(flag(F.size("red_flags") > 0)).alias("red_flag_rate"),
    )


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: tuple[float, ...], accuracy: int = 4096) -> DataFrame:
    """(key, n, p): exact percentiles of each group by linear interpolation, as an array in the order of ``shares``.

    Two scans: sketches of this size bound the ranks, and what lies between the bounds is counted. Null and NaN values are
    left out.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    return K.exact_at(rows, settled(K.sketched(rows, ["k"], "v", accuracy)), shares, K.rank_error(accuracy)).withColumnRenamed("k", key)


def latency_target(targets: dict[str, float]) -> Column:
    known = F.element_at(F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)), F.col("mode")) if targets else F.lit(None).cast("double")
    return F.coalesce(known, F.lit(policy.LATENCY_TARGETS["with_judge"]))


def latency_summary(latencies: DataFrame, targets: dict[str, float], exact: bool = True, accuracy: int = 4096) -> DataFrame:
    """Per mode of ``latencies`` (mode, seconds): n, mean, median and 95th percentile by linear interpolation, max,
    target and pass. ``exact=False`` takes the percentiles of ``latency_of_sketches``, which needs one scan instead of two.
    A mode without values has no row."""
    rows = latencies.select(F.col("mode").alias("k"), F.col("seconds").cast("double").alias("v")).where("v is not null and not isnan(v)")
    kept = settled(K.sketched(rows, ["k"], "v", accuracy))
    if not exact:
        return latency_of_sketches(kept.withColumnRenamed("k", "mode"), targets).drop("rank_error")
    of = K.exact_at(rows, kept, (0.5, 0.95), K.rank_error(accuracy)).drop("n")
    out = kept.select(F.col("k").alias("mode"), "n", (F.col("total") / F.col("n")).alias("mean_s"), F.col("most").alias("max_s")).join(of.withColumnRenamed("k", "mode"), "mode")
    target = latency_target(targets)
    return out.select("mode", "n", "mean_s", F.get("p", 0).alias("p50_s"), F.get("p", 1).alias("p95_s"), "max_s", target.alias("target_s"), (F.get("p", 1) <= target).alias("passed"))


def latency_of_sketches(kept: DataFrame, targets: dict[str, float], accuracy: int = 4096) -> DataFrame:
    """The summary of what runs have kept (mode, n, total, most, sketch), merged by mode; no measurement is read.

    Percentiles are values at most ``rank_error`` off in rank; all else is exact.
    """
    target, at = latency_target(targets), K.at_ranks("sketch", [0.5, 0.95])
    p50, p95 = F.get(at, 0), F.get(at, 1)
    return K.merged(kept, ["mode"]).select(
        "mode", "n", (F.col("total") / F.col("n")).alias("mean_s"), p50.alias("p50_s"), p95.alias("p95_s"), F.col("most").alias("max_s"),
        target.alias("target_s"), (p95 <= target).alias("passed"), F.lit(K.rank_error(accuracy)).alias("rank_error"),
    )


def stage_durations(times: DataFrame, known: tuple[str, ...] = policy.STAGES) -> DataFrame:
    """The last run of each known stage of ``times`` (stage, started_at, seconds)."""
    return times.where(F.col("stage").isin(*known)).groupBy("stage").agg(F.max_by("seconds", F.struct("started_at", "seconds")).alias("seconds"))


def gates(measured: DataFrame) -> DataFrame:
    """(gate, value, target, status) for ``measured`` (gate, value, target, at_least): PASS, FAIL or NOT RUN."""
    ok = F.when(F.col("at_least"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return measured.select("gate", "value", "target", F.when(F.col("value").isNull(), "NOT RUN").when(ok, "PASS").otherwise("FAIL").alias("status"))


def interpretation(corr: DataFrame, fit: DataFrame, template: DataFrame, role: DataFrame) -> DataFrame:
    """(note, subject, value): strongest correlation off the diagonal, worst and best level, worst template, role gap.

    The inputs are report-sized. Ties go to the first subject by name.
    """
    pair = corr.where("metric_a < metric_b").select(F.concat_ws(" ~ ", "metric_a", "metric_b").alias("s"), F.abs("r").alias("v"))
    best = lambda df, note, sign: df.groupBy().agg(F.min(F.struct((sign * F.col("v")).alias("k"), "s", "v")).alias("x")).select(F.lit(note).alias("note"), F.col("x.s").alias("subject"), F.col("x.v").alias("value"))
    of = lambda df, key: df.select(F.col(key).alias("s"), F.col("mean_failure_count").alias("v"))
    gap = role.groupBy().agg((F.max(F.when(F.col("role_type") == "niche", F.col("mean_failure_count"))) - F.max(F.when(F.col("role_type") == "standard", F.col("mean_failure_count")))).alias("v")).select(F.lit("niche_minus_standard").alias("note"), F.lit("role_type").alias("subject"), F.col("v").alias("value"))
    parts = [best(pair, "strongest_correlation", -1), best(of(fit, "fit_level"), "worst_fit_level", -1), best(of(fit, "fit_level"), "best_fit_level", 1), best(of(template, "resume_template"), "worst_template", -1), gap]
    return reduce(DataFrame.unionByName, parts)


def coverage(labels: DataFrame, least_rows: int = 250, most_share: float = 0.30) -> DataFrame:
    """(check, passed): enough rows, all fit levels present, niche roles present, no template over its share."""
    total = F.count("*")
    base = labels.agg((total >= least_rows).alias("enough_rows"), (F.count_distinct("generated_fit_label") == len(policy.FIT_LEVELS)).alias("all_fit_levels"), (F.count_if(F.col("role_type") == "niche") > 0).alias("has_niche"))
    share = labels.groupBy("resume_template").count().agg((F.max("count") / F.sum("count") <= most_share).alias("balanced_templates"))
    wide = base.crossJoin(share)  # one row each
    return wide.unpivot([], ["enough_rows", "all_fit_levels", "has_niche", "balanced_templates"], "check", "passed")


def repeated_ids(rows: DataFrame, key: str = "trace_id") -> DataFrame:
    return rows.groupBy(key).count().where("count > 1")


def last_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is highest by ``order``, nulls lowest; partial results are made before the shuffle.

    The keys stay columns of their own, so that what follows by the same keys needs no shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(rest))), F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(order))))
    found = rows.groupBy(*keys).agg(last.alias("_last"))
    return found.select(*(F.col(c) if c in keys else F.col("_last")[f"c{rest.index(c)}"].alias(c) for c in rows.columns))
