"""Queries over label rows, verdicts, latencies and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.operators import labels as L
from pairwright.operators import reports as R
from pairwright.operators import review as V
from pairwright.operators import sketches as K
from pairwright.plans.labelling import LABELS_SQL, label_rows
from pairwright.sources.records import settled
from pairwright.sources.stand_ins import AS_OF, pairs, table
from pairwright.sources.stored import stored_by

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rates(flags: tuple[str, ...] = policy.FLAGS) -> str:
    return ", ".join(f"avg({f}::INT::DOUBLE) AS {f}_rate" for f in flags)


BREAK_SQL = "count(*) AS count, avg(skills_overlap) AS mean_overlap, avg(failure_count) AS mean_failure_count"
NUM_SQL = "num AS (SELECT skills_overlap, " + ", ".join(f"{f}::INT::DOUBLE AS {f}" for f in policy.FLAGS) + " FROM labels_)"


def _r(a: str, b: str) -> str:
    return f"CASE WHEN count(*) < 2 OR stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN 0 ELSE " + ("1.0" if a == b else f"round_even(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 4)") + " END::DOUBLE"


CORR_SQL = "corr_ AS (" + " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {_r(a, b)} AS r FROM num" for a in R.METRICS for b in R.METRICS) + ")"


@query("a01_correlation", f"{LABELS_SQL}, {NUM_SQL}, {CORR_SQL} SELECT * FROM corr_")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.correlations(label_rows(spark, sf_dir))


@query("r2_correlation_table", f"{LABELS_SQL}, {NUM_SQL}, {CORR_SQL} SELECT metric_a, " + ", ".join(f"max(r) FILTER (metric_b = '{m}') AS {m}" for m in R.METRICS) + " FROM corr_ GROUP BY metric_a")
def correlation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.square(R.correlations(label_rows(spark, sf_dir)))


FIT_SQL = f"fit_ AS (SELECT coalesce(generated_fit_label, 'unlabeled') AS fit_level, {BREAK_SQL}, {_rates()} FROM labels_ GROUP BY 1)"
TEMPLATE_SQL = f"template_ AS (SELECT resume_template, {BREAK_SQL}, {_rates(('awkward_language', 'hallucinated_skills'))} FROM labels_ GROUP BY 1)"
ROLE_SQL = f"role_ AS (SELECT CASE WHEN is_niche THEN 'niche' ELSE 'standard' END AS role_type, {BREAK_SQL}, {_rates()} FROM labels_ GROUP BY 1)"


@query("a02_breakdown_by_fit", f"{LABELS_SQL}, {FIT_SQL} SELECT * FROM fit_")
def by_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_fit_level(label_rows(spark, sf_dir))


@query("a03_breakdown_by_template", f"{LABELS_SQL}, {TEMPLATE_SQL} SELECT * FROM template_")
def by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_template(label_rows(spark, sf_dir))


def niche_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("trace_id", F.col("job_description.metadata.is_niche_role").alias("is_niche_role")).where("is_niche_role")


def labelled_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one job the flag is a column of the pair, so no join is needed."""
    niche = F.col("job_description.metadata.is_niche_role")
    found = L.metrics(pairs(spark, sf_dir), AS_OF)
    return found.select("trace_id", F.col("fit_level").alias("generated_fit_label"), F.bround("overlap", 6).alias("skills_overlap"), *policy.FLAGS, "failure_count", F.col("resume.metadata.prompt_template").alias("resume_template"), F.when(niche, "niche").otherwise("standard").alias("role_type"))


@query("j1_role_join", f"{LABELS_SQL} SELECT trace_id, computed_fit_label, CASE WHEN is_niche THEN 'niche' ELSE 'standard' END AS role_type FROM labels_")
def role_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_role(label_rows(spark, sf_dir), niche_map(spark, sf_dir)).select("trace_id", "computed_fit_label", "role_type")


@query("a04_niche_vs_standard", f"{LABELS_SQL}, {ROLE_SQL} SELECT * FROM role_")
def niche_vs_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_role(labelled_roles(spark, sf_dir))


@query("a05_flag_summary", f"{LABELS_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS n_flagged, coalesce(avg({f}::INT::DOUBLE), 0) AS rate FROM labels_" for f in policy.FLAGS))
def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flag_summary(label_rows(spark, sf_dir))


@query("a06_failure_rates", f"{LABELS_SQL} SELECT count(*) AS row_count, {_rates((*policy.FLAGS, 'requires_human_review'))} FROM labels_")
def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.failure_rates(label_rows(spark, sf_dir))


@query("a07_fit_distribution", f"{LABELS_SQL} SELECT coalesce(computed_fit_label, 'unknown') AS fit_label, count(*) AS count FROM labels_ GROUP BY 1")
def fit_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fit_distribution(label_rows(spark, sf_dir))


@query("o1_fit_order", f"{LABELS_SQL}, {FIT_SQL} SELECT list_position(['excellent', 'good', 'partial', 'poor', 'complete_mismatch', 'unlabeled'], fit_level)::INT AS place, fit_level, count FROM fit_ ORDER BY 1")
def fit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_fit_level(label_rows(spark, sf_dir)).select(R.fit_order(F.col("fit_level")).cast("int").alias("place"), "fit_level", "count").orderBy("place")


@query("o2_spot_check", f"{LABELS_SQL} SELECT seq, trace_id, computed_fit_label FROM labels_ ORDER BY seq LIMIT 10")
def spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.metrics(pairs(spark, sf_dir), AS_OF)
    return found.select("seq", "trace_id", F.col("fit").alias("computed_fit_label")).orderBy("seq").limit(10)


@query("r1_long_rates", f"{LABELS_SQL}, {FIT_SQL} " + " UNION ALL ".join(f"SELECT fit_level, '{f}_rate' AS metric, {f}_rate AS rate FROM fit_" for f in policy.FLAGS))
def long_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.long_rates(R.by_fit_level(label_rows(spark, sf_dir)), "fit_level")


NOTES_SQL = """ SELECT 'strongest_correlation' AS note, subject, value FROM (SELECT metric_a || ' ~ ' || metric_b AS subject, abs(r) AS value FROM corr_ WHERE metric_a < metric_b ORDER BY 2 DESC, 1 LIMIT 1)
UNION ALL SELECT 'worst_fit_level', * FROM (SELECT fit_level, mean_failure_count FROM fit_ ORDER BY 2 DESC, 1 LIMIT 1)
UNION ALL SELECT 'best_fit_level', * FROM (SELECT fit_level, mean_failure_count FROM fit_ ORDER BY 2, 1 LIMIT 1)
UNION ALL SELECT 'worst_template', * FROM (SELECT resume_template, mean_failure_count FROM template_ ORDER BY 2 DESC, 1 LIMIT 1)
UNION ALL SELECT 'niche_minus_standard', 'role_type', max(mean_failure_count) FILTER (role_type = 'niche') - max(mean_failure_count) FILTER (role_type = 'standard') FROM role_"""


@query("a18_interpretation", f"{LABELS_SQL}, {NUM_SQL}, {CORR_SQL}, {FIT_SQL}, {TEMPLATE_SQL}, {ROLE_SQL}{NOTES_SQL}")
def interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_roles(spark, sf_dir)
    return R.interpretation(R.correlations(rows), R.by_fit_level(rows), R.by_template(rows), R.by_role(rows))


@query("a19_coverage", f"""{LABELS_SQL}, c AS (SELECT count(*) >= 250 AS enough_rows, count(DISTINCT generated_fit_label) = 5 AS all_fit_levels, count(*) FILTER (is_niche) > 0 AS has_niche,
  (SELECT max(n) / sum(n) <= 0.30::DOUBLE FROM (SELECT count(*)::DOUBLE AS n FROM labels_ GROUP BY resume_template)) AS balanced_templates FROM labels_)
SELECT 'enough_rows' AS "check", enough_rows AS passed FROM c UNION ALL SELECT 'all_fit_levels', all_fit_levels FROM c UNION ALL SELECT 'has_niche', has_niche FROM c UNION ALL SELECT 'balanced_templates', balanced_templates FROM c""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage(labelled_roles(spark, sf_dir))


@query("a20_repeated_ids", "SELECT 'line-' || l_orderkey || '-' || l_linenumber AS trace_id, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeated_ids(table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.lit("line"), "l_orderkey", "l_linenumber").alias("trace_id")))


# Verdicts: a document's quality and toxicity labels stand for what a judge said of the pair of the same number.
VERDICT_SQL = """verdicts AS (SELECT doc_id AS seq, 'pair-' || doc_id AS trace_id, CASE WHEN doc_id % 13 <> 0 THEN doc_id % 7 = 0 END AS has_hallucinations, CASE WHEN doc_id % 13 <> 0 THEN toxic = 1 END AS has_awkward_language,
  CASE WHEN doc_id % 13 <> 0 THEN quality * 0.5::DOUBLE + (doc_id % 10) / 20.0::DOUBLE END AS score,
  CASE WHEN doc_id % 13 = 0 OR doc_id % 2 = 0 THEN [] ELSE [' Check role ' || (doc_id % 9) || '. Then more.', 'Ask for dates'] END AS recs,
  CASE WHEN doc_id % 13 <> 0 AND doc_id % 5 = 0 THEN ['gap'] ELSE [] END AS reds, CASE WHEN doc_id % 13 = 0 THEN 'timeout' END AS judge_error FROM labels)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, fine = F.col("doc_id"), F.col("doc_id") % 13 != 0
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "labels").select(
        k.alias("seq"), F.concat(F.lit("pair-"), k).alias("trace_id"), F.when(fine, k % 7 == 0).alias("has_hallucinations"), F.when(fine, F.col("toxic") == 1).alias("has_awkward_language"),
        F.when(fine, F.col("quality") * 0.5 + (k % 10) / F.lit(20.0)).alias("overall_quality_score"),
        F.when(fine & (k % 2 != 0), F.array(F.concat(F.lit(" Check role "), k % 9, F.lit(". Then more.")), F.lit("Ask for dates"))).otherwise(empty).alias("recommendations"),
        F.when(fine & (k % 5 == 0), F.array(F.lit("gap"))).otherwise(empty).alias("red_flags"), F.when(~fine, "timeout").alias("judge_error"),
    )


MERGED_SQL = f"""{LABELS_SQL}, {VERDICT_SQL},
merged AS (SELECT l.* EXCLUDE (requires_human_review, review_reason_codes), list_concat(review_reason_codes, list_filter([CASE WHEN judge_error IS NOT NULL THEN 'llm_judge_error' END,
  CASE WHEN v.trace_id IS NOT NULL AND judge_error IS NULL AND (has_hallucinations OR has_awkward_language OR len(reds) > 0 OR score < 0.4::DOUBLE) THEN 'llm_judge_flagged' END,
  CASE WHEN v.trace_id IS NOT NULL AND judge_error IS NULL AND len(recs) > 0 AND score < 0.7::DOUBLE THEN 'llm_judge_recommendation' END], lambda c: c IS NOT NULL)) AS codes
  FROM labels_ l LEFT JOIN verdicts v ON v.trace_id = l.trace_id)"""


@query("j2_merged_verdicts", f"{MERGED_SQL} SELECT trace_id, array_to_string(codes, ',') AS review_reason_codes, len(codes) > 0 AS requires_human_review FROM merged")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.merge_verdicts(label_rows(spark, sf_dir), verdicts(spark, sf_dir)).select("trace_id", F.array_join("review_reason_codes", ",").alias("review_reason_codes"), "requires_human_review")


QUEUE_SQL = f"""{LABELS_SQL}, {VERDICT_SQL},
queue_ AS (SELECT l.trace_id, 'human_review_flag' AS queue_reason, true AS requires_human_review, array_to_string(review_reason_codes, ',') AS review_reason_codes, computed_fit_label, computed_fit_label AS adjudicated_fit_label, score, coalesce(recs, []) AS recs, coalesce(reds, []) AS reds
  FROM labels_ l LEFT JOIN verdicts v ON v.trace_id = l.trace_id WHERE requires_human_review
UNION ALL SELECT v.trace_id, 'recommendation_only', coalesce(requires_human_review, false), coalesce(array_to_string(review_reason_codes, ','), ''), computed_fit_label, computed_fit_label, score, recs, reds
  FROM verdicts v LEFT JOIN labels_ l ON v.trace_id = l.trace_id WHERE judge_error IS NULL AND len(recs) > 0 AND NOT coalesce(requires_human_review, false))"""


def queue_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, adjudications and verdicts."""
    found = L.metrics(pairs(spark, sf_dir), AS_OF).withColumn("review_reason_codes", L.reason_codes())
    rows = found.select("seq", "trace_id", F.col("fit").alias("computed_fit_label"), "review_reason_codes", (F.size("review_reason_codes") > 0).alias("requires_human_review"))
    rows = settled(rows)  # read four times
    return rows, rows.select("seq", "trace_id", F.col("computed_fit_label").alias("adjudicated_fit_label")), verdicts(spark, sf_dir)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.review_queue(*queue_parts(spark, sf_dir))


def _queue_query(name: str, reason: str | None):
    where = f" WHERE queue_reason = '{reason}'" if reason else ""
    sql = f"{QUEUE_SQL} SELECT trace_id, queue_reason, requires_human_review, review_reason_codes, computed_fit_label, adjudicated_fit_label, score AS judge_overall_quality_score, array_to_string(recs, '|') AS judge_recommendations, array_to_string(reds, '|') AS judge_red_flags FROM queue_{where}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = queue(spark, sf_dir)
        rows = rows.where(F.col("queue_reason") == reason) if reason else rows
        return rows.withColumns({"review_reason_codes": F.array_join("review_reason_codes", ","), "judge_recommendations": F.array_join("judge_recommendations", "|"), "judge_red_flags": F.array_join("judge_red_flags", "|")})

    query(name, sql)(run)


_queue_query("j3_flagged_queue", "human_review_flag")
_queue_query("j4_recommendation_queue", "recommendation_only")
_queue_query("x1_review_queue", None)


def stored_queue_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, adjudications and verdicts, each stored by trace id."""
    return tuple(stored_by(df, buckets=8) for df in queue_parts(spark, sf_dir))


@query("x1_stored_queue", f"{QUEUE_SQL} SELECT trace_id, queue_reason, requires_human_review, array_to_string(recs, '|') AS judge_recommendations FROM queue_")
def stored_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.review_queue(*stored_queue_parts(spark, sf_dir))
    return rows.select("trace_id", "queue_reason", "requires_human_review", F.array_join("judge_recommendations", "|").alias("judge_recommendations"))


@query("j5_last_per_id", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS last_ts FROM events GROUP BY user_id")
def last_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.last_per(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_type", F.col("ts").alias("last_ts"))


@query("a08_judge_summary", f"""WITH {VERDICT_SQL} SELECT count(*) AS row_count, count(judge_error) AS judge_error_count, avg(has_hallucinations::INT::DOUBLE) FILTER (judge_error IS NULL) AS hallucination_rate,
avg(has_awkward_language::INT::DOUBLE) FILTER (judge_error IS NULL) AS awkward_language_rate, avg(score) FILTER (judge_error IS NULL) AS mean_overall_quality_score, avg((len(reds) > 0)::INT::DOUBLE) FILTER (judge_error IS NULL) AS red_flag_rate FROM verdicts""")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.judge_summary(verdicts(spark, sf_dir))


@query("a09_queue_counts", f"{QUEUE_SQL} SELECT queue_reason, count(*) AS n, count(*) FILTER (requires_human_review) AS n_review FROM queue_ GROUP BY 1")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.queue_counts(queue(spark, sf_dir))


@query("a09_recommendation_openings", f"{QUEUE_SQL}, e AS (SELECT trim(unnest(recs)) AS r FROM queue_) SELECT split_part(r, '.', 1)[1:80] AS text, count(*) AS count FROM e WHERE r <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recommendation_openings(queue(spark, sf_dir))


@query("a14_latency_summary", """SELECT event_type AS mode, count(value) AS n, avg(value) AS mean_s, quantile_cont(value::DOUBLE, 0.5) AS p50_s, quantile_cont(value::DOUBLE, 0.95) AS p95_s, max(value) AS max_s,
CASE event_type WHEN 'click' THEN 2.0::DOUBLE ELSE 10.0::DOUBLE END AS target_s, quantile_cont(value::DOUBLE, 0.95) <= CASE event_type WHEN 'click' THEN 2.0::DOUBLE ELSE 10.0::DOUBLE END AS passed FROM events GROUP BY event_type""")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("seconds"))
    return R.latency_summary(rows, {"click": policy.LATENCY_TARGETS["rules_only"]})


DAY_SQL = "events_ AS (SELECT event_type AS mode, value::DOUBLE AS v FROM events WHERE value IS NOT NULL)"


@query("a14_merged_runs", f"""WITH {DAY_SQL} SELECT mode, count(*) AS n, avg(v) AS mean_s, max(v) AS max_s, TRUE AS p50_in_bounds, TRUE AS p95_in_bounds FROM events_ GROUP BY mode""")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day is a run that keeps sketches; merged, their percentiles lie within twice the stated error in rank."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("run"), F.col("event_type").alias("mode"), F.col("value").cast("double").alias("seconds"))
    runs = settled(K.sketched(events, ["run", "mode"], "seconds"))
    told = F.broadcast(R.latency_of_sketches(runs, {}))  # one row a mode
    known = events.where("seconds is not null").select("mode", "seconds").join(told.select("mode", "n", "p50_s", "p95_s", "rank_error"), "mode")

    def inside(at: str, share: float) -> Column:
        low, high = F.count_if(F.col("seconds") < F.col(at)) / F.count("*"), F.count_if(F.col("seconds") <= F.col(at)) / F.count("*")
        slack = 2 * F.max("rank_error") + 1 / F.count("*")
        return (low - slack <= share) & (high + slack >= share)

    checked = known.groupBy("mode").agg(inside("p50_s", 0.5).alias("p50_in_bounds"), inside("p95_s", 0.95).alias("p95_in_bounds"))
    return told.select("mode", "n", "mean_s", "max_s").join(checked, "mode")


STAGE_OF = {"click": "generation", "view": "validation", "purchase": "analysis", "error": "correction", "signup": "other"}


@query("a15_stage_durations", "WITH s AS (SELECT CASE event_type WHEN 'click' THEN 'generation' WHEN 'view' THEN 'validation' WHEN 'purchase' THEN 'analysis' WHEN 'error' THEN 'correction' ELSE 'other' END AS stage, ts, value FROM events) SELECT stage, arg_max(value, (ts, value)) AS seconds FROM s WHERE stage <> 'other' GROUP BY stage")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STAGE_OF.items() for x in kv)), F.col("event_type")), F.lit("other"))
    return R.stage_durations(table(spark, sf_dir, "events").select(stage.alias("stage"), F.col("ts").alias("started_at"), F.col("value").alias("seconds")))
