"""Queries of synthesis, correction, splits and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.operators import correction as C
from pairwright.operators import policy_splits as Y
from pairwright.operators import reports as R
from pairwright.operators import spread_pick as SP
from pairwright.operators import synthesis as S
from pairwright.plans.labelling import LABELS_SQL, _quoted, label_rows
from pairwright.sources.stand_ins import PAIRS_SQL, pairs, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEED = 42


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _map(values: dict[str, object]) -> str:
    return "CASE fit_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


# --- generation: every customer is a job -------------------------------------------------------------------------


def customer_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_index"))


PLAN_SQL = f"""WITH plan AS (SELECT c_custkey AS job_index, i::INT AS resume_index, {_quoted(S.JOB_TEMPLATES)}[c_custkey % 5 + 1] AS job_template_id, {_quoted(S.RESUME_TEMPLATES)}[(c_custkey + i) % 5 + 1] AS resume_template_id,
{_quoted(policy.FIT_LEVELS)}[i % 5 + 1] AS fit_level FROM customer, unnest(range(7)) AS t(i))"""


def customer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.generation_plan(customer_jobs(spark, sf_dir), 7, 0.2, SEED)


@query("g1_plan", f"{PLAN_SQL} SELECT * FROM plan")
def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_plan(spark, sf_dir).drop("niche_target")


@query("g1_niche_jobs", "SELECT round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT AS n_niche, count(*) AS n_jobs FROM customer")
def niche_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_plan(spark, sf_dir).where("resume_index = 0").agg(F.count_if(F.col("niche_target")).alias("n_niche"), F.count("*").alias("n_jobs"))


DRAW_SQL = "('0x' || sha256('42:{what}:' || {key})[1:15])::BIGINT"
NICHE_SQL = f"niche_jobs AS (SELECT c_custkey AS job_index, row_number() OVER (ORDER BY {DRAW_SQL.format(what='niche', key='c_custkey')}, c_custkey) <= round_even((SELECT count(*) FROM customer) * 0.2::DOUBLE, 0) AS niche_target FROM customer)"
FOCUS_SQL = f"CASE WHEN niche_target THEN {_quoted(S.NICHE_FOCI)} ELSE {_quoted(S.STANDARD_FOCI)} END[{DRAW_SQL.format(what='focus', key='job_index')} % 5 + 1]"


@query("g2_industry_focus", f"{PLAN_SQL}, {NICHE_SQL} SELECT job_index, resume_index, niche_target, {FOCUS_SQL} AS industry FROM plan JOIN niche_jobs USING (job_index)")
def focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_plan(spark, sf_dir).select("job_index", "resume_index", "niche_target", S.industry_focus(F.col("niche_target"), F.col("job_index"), SEED).alias("industry"))


@query("g3_contact", f"""WITH c AS (SELECT c_custkey AS k, {_quoted(S.FIRST_NAMES)}[c_custkey % 6 + 1] AS f, {_quoted(S.LAST_NAMES)}[c_custkey % 6 + 1] AS l FROM customer)
SELECT k, f || ' ' || l AS name, lower(f) || '.' || lower(l) || k || '@example.com' AS email, 'US' AS phone_region, '+1202555' || lpad((1000 + k % 9000)::VARCHAR, 4, '0') AS phone, 'Remote' AS location FROM c""")
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), S.contact(F.col("c_custkey"), F.lit("Remote")).alias("c")).select("k", "c.*")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.generated_pairs(customer_jobs(spark, sf_dir), 7, 0.2, SEED)


def _drawn_sql(items: str, n: str, what: str) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda x: sha256('{what}:' || index || ':' || x) || x)), lambda s: s[65:])[1:{n}]"


SKILLS_SQL = f"""{PLAN_SQL}, {NICHE_SQL}, j AS (SELECT *, job_index * 7 + resume_index AS index, {FOCUS_SQL} AS industry FROM plan JOIN niche_jobs USING (job_index)),
r AS (SELECT *, list_transform(range(1, 6), lambda i: industry || ' skill ' || i) AS required, {_quoted(S.FALLBACK_SKILLS[:3])} AS preferred FROM j),
t AS (SELECT *, {_drawn_sql('required', f"round_even(5 * {_map({k: f'{v[0]}::DOUBLE' for k, v in S.BY_FIT.items()})}, 0)::INT", 'required')} AS taken FROM r),
s AS (SELECT index, fit_level, list_concat(taken, {_drawn_sql('preferred', _map({k: v[1] for k, v in S.BY_FIT.items()}), 'preferred')}, {_drawn_sql(_quoted(S.UNRELATED_SKILLS), '3', 'unrelated')})[1:8] AS names FROM t)"""


@query("g4_resume_skills", f"""{SKILLS_SQL} SELECT 'pair-' || sha256('42:' || index)[1:16] AS trace_id, fit_level, array_to_string(names, '|') AS skills,
'Knows ' || array_to_string(names[1:3], ', ') || '; made for the level ' || fit_level AS summary FROM s""")
def generated_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(spark, sf_dir).select("trace_id", "fit_level", F.array_join(F.transform("resume.skills", lambda s: s["name"]), "|").alias("skills"), F.col("resume.summary").alias("summary"))


@query("g5_generated_pairs", f"""{PLAN_SQL} SELECT job_index * 7 + resume_index AS seq, 'pair-' || sha256('42:' || (job_index * 7 + resume_index))[1:16] AS trace_id, fit_level, job_template_id, resume_template_id, greatest(2005, 2024 - greatest(1,
round_even({_map({k: f'{v[3]}::DOUBLE' for k, v in S.BY_FIT.items()})} * CASE WHEN job_index % 3 = 0 THEN 6 ELSE 3 END, 0)::INT)) AS start_year FROM plan""")
def generated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _generated(spark, sf_dir)
    return rows.select("seq", "trace_id", "fit_level", "job_template_id", F.col("resume.metadata.prompt_template").alias("resume_template_id"), F.year(F.get(F.col("resume.experience"), 0)["start_date"]).alias("start_year"))


@query("a11_generated_rates", f"{PLAN_SQL} SELECT avg((resume_index >= c_nationkey % 8)::INT::DOUBLE) AS resume_fallback_rate, count(*) AS n_pairs FROM plan JOIN customer ON job_index = c_custkey")
def generated_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation keys stand for how many of a job's resumes a model answered."""
    answered = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_index"), (F.col("c_nationkey") % 8).cast("int").alias("answered_resumes"))
    rows = S.generated_pairs(answered, 7, 0.2, SEED)
    return rows.agg(F.avg(F.col("resume.metadata.used_fallback").cast("double")).alias("resume_fallback_rate"), F.count("*").alias("n_pairs"))


@query("a11_niche_share", f"WITH {PAIRS_SQL} SELECT avg(is_niche::INT::DOUBLE) AS niche_share, count(*) AS n FROM p")
def niche_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).agg(F.avg(F.col("job_description.metadata.is_niche_role").cast("double")).alias("niche_share"), F.count("*").alias("n"))


@query("a12_plan_distribution", f"{PLAN_SQL} SELECT 'job_template_id' AS dimension, job_template_id AS value, count(*) AS count FROM plan GROUP BY ALL UNION ALL SELECT 'resume_template_id', resume_template_id, count(*) FROM plan GROUP BY ALL UNION ALL SELECT 'fit_level', fit_level, count(*) FROM plan GROUP BY ALL UNION ALL SELECT 'niche_target', v, n FROM (SELECT unnest(['true', 'false']) AS v, unnest([round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT * 7, (count(*) - round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT) * 7]) AS n FROM customer)")
def plan_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.plan_distribution(customer_plan(spark, sf_dir))


JOB_TEMPLATE = "Write a job in {industry_focus}. Keep {industry_focus} in view."


@query("p27_job_prompts", f"SELECT c_custkey AS k, replace('{JOB_TEMPLATE}', '{{industry_focus}}', c_mktsegment) AS prompt FROM customer")
def job_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), S.filled(F.lit(JOB_TEMPLATE), {"industry_focus": F.col("c_mktsegment")}).alias("prompt"))


@query("p28_fit_constraints", f"""WITH {PAIRS_SQL}, c AS (SELECT trace_id, {_map({k: f"'{v[0]:.2f} to {v[1]:.2f}'" for k, v in policy.FIT_BANDS.items()})} AS band, CASE fit_level WHEN 'complete_mismatch' THEN 0 ELSE greatest(1, round_even(greatest(1, len(required)) * {_map({k: f'{v[0]}::DOUBLE' for k, v in S.BY_FIT.items()})}, 0)::INT) END AS target,
{_map({k: v[4] for k, v in S.BY_FIT.items()})} AS unrelated FROM p WHERE fit_level IS NOT NULL)
SELECT trace_id, 'Overlap from ' || band || '; required skills: ' || target || '; unrelated skills: up to ' || unrelated AS block FROM c""")
def fit_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).where("fit_level is not null")
    return rows.select("trace_id", S.constraint_block(S.fit_constraint(F.size("job_description.requirements.required_skills"), F.col("fit_level"))).alias("block"))


@query("p29_niche_role", "SELECT p_partkey, regexp_matches(lower(p_name || ' ' || p_type), 'ring|economy') AS is_niche, regexp_matches(lower(p_name || ' ' || p_type), 'quantum|bioinformatics|compiler|cryptography|embedded') AS by_policy FROM part")
def niche_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).rlike("ring|economy").alias("is_niche"), S.niche_role(F.col("p_name"), F.array("p_type")).alias("by_policy"))


@query("p30_skill_category", """WITH s AS (SELECT o_orderkey AS k, o_orderpriority || ' ' || ['Python', 'Roadmap', 'Sales', 'Writing'][o_orderkey % 4 + 1] AS skill FROM orders)
SELECT k, CASE WHEN regexp_matches(lower(skill), 'python|java|javascript|react|sql|docker|kubernetes|aws') THEN 'Programming' WHEN regexp_matches(lower(skill), 'management|leadership|roadmap|strategy') THEN 'Management' WHEN regexp_matches(lower(skill), 'sales|customer|support|outreach') THEN 'Business' ELSE 'General' END AS category FROM s""")
def skill_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    skill = F.concat_ws(" ", "o_orderpriority", F.get(S.words(("Python", "Roadmap", "Sales", "Writing")), (F.col("o_orderkey") % 4).cast("int")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), S.skill_category(skill).alias("category"))


@query("p31_resume_summary", f"""WITH {PAIRS_SQL} SELECT trace_id, 'Knows ' || CASE WHEN len(skills) = 0 THEN 'no skill by name' ELSE array_to_string(skills[1:3], ', ') END || '; made for the level ' || coalesce(fit_level, 'any') AS summary FROM p""")
def resume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("trace_id", S.resume_summary(F.transform("resume.skills", lambda s: s["name"]), F.coalesce("fit_level", F.lit("any"))).alias("summary"))


@query("p32_requirements", """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [o_orderpriority] END AS required, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'senior' ELSE 'mid_level' END AS lvl,
CASE WHEN o_orderkey % 5 = 0 THEN 'Lead ' ELSE '' END || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey % 9 END AS years FROM orders),
l AS (SELECT *, coalesce(lvl, CASE WHEN regexp_matches(lower(title), 'senior|lead|principal|staff|director|head|vp') THEN 'senior' WHEN years <= 1 THEN 'entry_level' WHEN years >= 5 THEN 'senior' ELSE 'mid_level' END) AS known FROM o)
SELECT k, CASE WHEN len(required) > 0 THEN array_to_string(required, '|') ELSE 'Communication|Problem Solving|Project Coordination|Documentation|Stakeholder Collaboration' END AS required_skills, known AS experience_level, coalesce(years, CASE known WHEN 'entry_level' THEN 1 WHEN 'mid_level' THEN 3 ELSE 6 END) AS years_experience FROM l""")
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    required = F.when(k % 3 != 0, F.array("o_orderpriority"))
    level = F.when(k % 4 == 1, "senior").when(k % 4 > 1, "mid_level")
    title = F.concat(F.when(k % 5 == 0, "Lead ").otherwise(""), "o_orderpriority")
    out = S.coerced_requirements(required, level, title, F.when(k % 2 != 0, k % 9))
    return table(spark, sf_dir, "orders").select(k.alias("k"), out.alias("r")).select("k", F.array_join("r.required_skills", "|").alias("required_skills"), "r.experience_level", "r.years_experience")


# --- correction: a user's events of a day are the attempts at one record ---------------------------------------------

ATTEMPT_SQL = """WITH ranked AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d %H') AS record, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d %H') ORDER BY ts, event_id) AS attempt, event_type FROM events),
attempts AS (SELECT record, attempt, event_type = 'purchase' AS succeeded, CASE WHEN event_type IN ('purchase', 'view') THEN [] ELSE [event_type] END AS cats FROM ranked WHERE attempt <= 3),
done AS (SELECT record, count(*) AS attempts, arg_max(succeeded, attempt) AS succeeded, arg_max(cats, attempt) AS cats FROM attempts GROUP BY record)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    hour = F.date_format("ts", "yyyy-MM-dd HH")
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", hour).alias("record"), "ts", "event_id", "event_type")
    rows = rows.withColumn("attempt", F.row_number().over(Window.partitionBy("record").orderBy("ts", "event_id"))).where("attempt <= 3")
    return rows.select("record", "attempt", (F.col("event_type") == "purchase").alias("succeeded"), F.when(F.col("event_type").isin("purchase", "view"), F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("error_categories"))


@query("a13_correction_summary", f"{ATTEMPT_SQL} SELECT count(*) AS total_invalid_records, count(*) FILTER (succeeded) AS corrected_records, count(*) FILTER (NOT succeeded) AS permanently_failed_records, avg(succeeded::INT::DOUBLE) AS correction_success_rate, avg(attempts) AS average_attempts, avg(succeeded::INT::DOUBLE) > 0.5::DOUBLE AS meets_success_criteria FROM done")
def correction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.correction_summary(C.outcomes(attempts(spark, sf_dir)))


@query("a13_attempt_histogram", f"{ATTEMPT_SQL} SELECT a AS attempts, (SELECT count(*) FROM done WHERE done.attempts = a) AS n FROM unnest(range(1, 4)) AS t(a)")
def attempt_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.attempt_histogram(C.outcomes(attempts(spark, sf_dir)))


@query("a13_failure_reasons", f"{ATTEMPT_SQL}, r AS (SELECT unnest(CASE WHEN len(cats) = 0 THEN ['unknown'] ELSE cats END) AS reason FROM done WHERE NOT succeeded) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.failure_reasons(C.outcomes(attempts(spark, sf_dir)))


@query("w1_last_attempt", f"{ATTEMPT_SQL} SELECT record, attempts AS attempt, succeeded FROM done")
def last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_attempts(attempts(spark, sf_dir)).select("record", "attempt", "succeeded")


@query("x2_corrected_or_not", f"{ATTEMPT_SQL} SELECT record, CASE WHEN succeeded THEN 'corrected' ELSE 'still_invalid' END AS outcome FROM done")
def corrected_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = C.outcomes(attempts(spark, sf_dir))
    fixed = done.where("succeeded").select("record")
    rest = done.select("record").join(fixed, "record", "left_anti")
    return fixed.withColumn("outcome", F.lit("corrected")).unionByName(rest.withColumn("outcome", F.lit("still_invalid")))


@query("p26_correction_prompts", f"""SELECT p_partkey, sha256('{C.TASK.replace("'", "''")}' || chr(10) || 'Table: jobs' || chr(10) || 'Attempt 1 of at most 3' || chr(10) || 'Errors:' || chr(10) || '1. loc=' || p_type || ' | type=missing | category=missing_required_fields | message=Field required' || chr(10) || 'Record:' || chr(10) || p_name || chr(10) || '{C.ANSWER}' || chr(10)) AS prompt_sha256 FROM part""")
def correction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.struct(F.col("p_type").alias("loc"), F.lit("missing").alias("type"), F.lit("Field required").alias("msg"), F.lit("missing_required_fields").alias("category"))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(C.correction_prompt(F.lit("jobs"), F.array(error), F.col("p_name"), 1, 3), 256).alias("prompt_sha256"))


P95_SQL = "latency_ AS (SELECT event_type AS mode, quantile_cont(value::DOUBLE, 0.95) AS p95 FROM events GROUP BY 1)"


@query("a16_pipeline_summary", f"{LABELS_SQL}, lab AS (SELECT count(*) AS n_pairs, avg(failure_count) AS mean_failures, count(*) FILTER (requires_human_review) AS n_review FROM labels_), cor AS ({ATTEMPT_SQL} SELECT avg(succeeded::INT::DOUBLE) AS rate FROM done), {P95_SQL} SELECT n_pairs, mean_failures, n_review, (SELECT rate FROM cor) AS correction_success_rate, (SELECT max(p95) FROM latency_) AS worst_p95_s FROM lab")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_rows(spark, sf_dir).agg(F.count("*").alias("n_pairs"), F.avg("failure_count").alias("mean_failures"), F.count_if(F.col("requires_human_review")).alias("n_review"))
    rate = C.correction_summary(C.outcomes(attempts(spark, sf_dir))).select("correction_success_rate")
    latency = R.latency_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("seconds")), {}).agg(F.max("p95_s").alias("worst_p95_s"))
    return labels.crossJoin(rate).crossJoin(latency)  # one row each


@query("a17_gates", f"""{ATTEMPT_SQL}, {P95_SQL}, m AS (SELECT mode || '_p95' AS gate, p95 AS value, 10.0::DOUBLE AS target, p95 <= 10 AS ok FROM latency_ UNION ALL SELECT 'correction', avg(succeeded::INT::DOUBLE), 0.5::DOUBLE, avg(succeeded::INT::DOUBLE) >= 0.5::DOUBLE FROM done UNION ALL SELECT 'api', NULL, 2.0::DOUBLE, NULL)
SELECT gate, value, target, CASE WHEN value IS NULL THEN 'NOT RUN' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM m""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = R.latency_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("seconds")), {})
    rows = latency.select(F.concat("mode", F.lit("_p95")).alias("gate"), F.col("p95_s").alias("value"), "target_s", F.lit(False).alias("at_least")).withColumnRenamed("target_s", "target")
    fixed = C.correction_summary(C.outcomes(attempts(spark, sf_dir))).select(F.lit("correction").alias("gate"), F.col("correction_success_rate").alias("value"), F.lit(policy.CORRECTION_TARGET).alias("target"), F.lit(True).alias("at_least"))
    absent = fixed.select(F.lit("api").alias("gate"), F.lit(None).cast("double").alias("value"), F.lit(policy.LATENCY_TARGETS["rules_only"]).alias("target"), F.lit(False).alias("at_least"))
    return R.gates(rows.unionByName(fixed).unionByName(absent))


# --- policy ----------------------------------------------------------------------------------------------------------

SPLIT_SQL = """g AS (SELECT job_id, min(industry) AS industry FROM p GROUP BY job_id),
k AS (SELECT job_id, (row_number() OVER (PARTITION BY industry ORDER BY sha256('42:' || job_id), job_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY industry) AS r FROM g),
s AS (SELECT p.*, CASE WHEN r <= 0.6::DOUBLE THEN 'calibration' WHEN r <= 0.8::DOUBLE THEN 'validation' ELSE 'holdout' END AS split FROM p JOIN k USING (job_id))"""


def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("trace_id", "job_id", "fit_level", F.col("job_description.industry").alias("industry"), F.col("resume.metadata.prompt_template").alias("resume_template"))
    return Y.split_by_group(rows, "job_id", ["industry"], seed=SEED)


@query("y1_split", f"WITH {PAIRS_SQL}, {SPLIT_SQL} SELECT trace_id, job_id, split FROM s")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pairs(spark, sf_dir).select("trace_id", "job_id", "split")


POLICY_SPLIT_SQL = """g AS (SELECT job_id, min(industry) AS industry, min(seniority) AS seniority FROM p GROUP BY job_id),
k AS (SELECT job_id, (row_number() OVER (PARTITION BY industry, seniority ORDER BY sha256('42:' || job_id), job_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY industry, seniority) AS r FROM g),
s AS (SELECT p.*, CASE WHEN r <= 0.6::DOUBLE THEN 'calibration' WHEN r <= 0.8::DOUBLE THEN 'validation' ELSE 'holdout' END AS split FROM p JOIN k USING (job_id))"""


def policy_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("trace_id", "job_id", "fit_level", F.col("job_description.industry").alias("industry"), F.col("job_description.requirements.experience_level").alias("seniority"))
    return Y.split_by_group(rows, "job_id", ["industry", "seniority"], seed=SEED)


@query("y1_policy_split", f"WITH {PAIRS_SQL}, {POLICY_SPLIT_SQL} SELECT trace_id, job_id, split FROM s")
def policy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_split_pairs(spark, sf_dir).select("trace_id", "job_id", "split")


@query("y1_fit_balance", f"WITH {PAIRS_SQL}, {POLICY_SPLIT_SQL}, b AS (SELECT split, coalesce(fit_level, 'unlabeled') AS fit_level, count(*) AS n FROM s GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY split) AS share FROM b")
def fit_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.fit_balance(policy_split_pairs(spark, sf_dir))


@query("y2_balanced_pick", f"WITH {PAIRS_SQL}, k AS (SELECT trace_id, fit_level, row_number() OVER (PARTITION BY fit_level ORDER BY sha256('42:' || trace_id), trace_id) AS pick FROM p WHERE fit_level IS NOT NULL) SELECT trace_id, fit_level FROM k WHERE pick <= 50")
def balanced_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.balanced_pick(pairs(spark, sf_dir).select("trace_id", "fit_level"), dict.fromkeys(policy.FIT_LEVELS, 50), seed=SEED).select("trace_id", "fit_level")


PICK_SQL = """ranked AS (SELECT trace_id, job_id, fit_level, row_number() OVER (PARTITION BY job_id ORDER BY sha256('42:' || trace_id), trace_id) AS place, count(*) OVER (PARTITION BY job_id) AS n FROM p WHERE fit_level IS NOT NULL),
chosen AS (SELECT job_id FROM ranked WHERE n >= 5 GROUP BY job_id ORDER BY sha256('42:' || job_id), job_id LIMIT 50)"""


@query("y2_policy_pick", f"WITH {PAIRS_SQL}, {PICK_SQL} SELECT trace_id, job_id, fit_level FROM ranked JOIN chosen USING (job_id) WHERE place <= 5")
def policy_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.policy_pick(pairs(spark, sf_dir).where("fit_level is not null").select("trace_id", "job_id", "fit_level"), "job_id", seed=SEED).select("trace_id", "job_id", "fit_level")


@query("y2_pick_report", f"WITH {PAIRS_SQL}, {PICK_SQL}, x AS (SELECT * FROM ranked JOIN chosen USING (job_id) WHERE place <= 5) SELECT count(*) AS n, count(DISTINCT job_id) AS n_jobs, (SELECT min(c) FROM (SELECT count(*) AS c FROM x GROUP BY job_id)) AS least_per_job, count(*) >= 250 AND count(DISTINCT job_id) >= 50 AS passed FROM x")
def pick_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.pick_report(policy_pick(spark, sf_dir), "job_id")


@query("y2_spread_pick")
def spread_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("trace_id", "job_id", "fit_level")
    return SP.spread_pick(rows, "job_id", dict.fromkeys(policy.FIT_LEVELS, 50), seed=SEED).select("trace_id", "job_id", "fit_level")


#: What the policy asks for, where there are jobs enough: no level and no job is short.
ENOUGH_SQL = "enough AS (SELECT count(*) >= 100 AS yes FROM (SELECT job_id FROM p WHERE fit_level IS NOT NULL GROUP BY job_id HAVING count(*) >= 5 AND count(DISTINCT fit_level) >= 2))"


@query("y2_spread_report", f"WITH {PAIRS_SQL}, {ENOUGH_SQL} SELECT 250::BIGINT AS n, 50::BIGINT AS n_jobs, 5::BIGINT AS least_per_job, 50::BIGINT AS least_per_level, 0::BIGINT AS short_of_levels, 0::BIGINT AS short_of_jobs, TRUE AS passed FROM enough WHERE yes")
def spread_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.spread_report(spread_pick(spark, sf_dir), "job_id", dict.fromkeys(policy.FIT_LEVELS, 50))


@query("y3_freeze_gate", f"{LABELS_SQL}, v AS (SELECT avg((generated_fit_label = computed_fit_label)::INT::DOUBLE) AS agreement, sum((generated_fit_label IS NULL)::INT + (resume_template IS NULL)::INT)::BIGINT AS missing_fields, count(*) FILTER (generated_fit_label IS NULL) AS unresolved FROM labels_) SELECT *, agreement >= 0.8::DOUBLE AND missing_fields = 0 AND unresolved = 0 AS passed FROM v")
def freeze_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_rows(spark, sf_dir)
    return Y.freeze_gate(rows.withColumn("label", F.col("generated_fit_label")), rows.select("trace_id", F.col("computed_fit_label").alias("label")), ["generated_fit_label", "resume_template"])


@query("y4_shared_templates", f"WITH {PAIRS_SQL}, {SPLIT_SQL} SELECT DISTINCT template AS resume_template FROM s WHERE split = 'holdout' AND template IN (SELECT template FROM s WHERE split <> 'holdout')")
def shared_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.shared_templates(split_pairs(spark, sf_dir))
