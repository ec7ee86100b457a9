"""Queries over pairs: projections and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.functions.skills import analysis_skill, jaccard, plain_skill, skill_set
from pairwright.functions.text import count_terms, json_object, repeated_nearby, repeated_windows, tokens
from pairwright.operators import labels as L
from pairwright.sources.stand_ins import AS_OF, PAIRS_SQL, pairs, table


def _quoted(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _norm(x: str) -> str:
    """P1 in DuckDB."""
    bare = rf"regexp_replace(trim(lower({x})), '\b(developer|engineer)\b|\.js\b', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({bare}, '\d+(?:\.\d+)?', '', 'g'), '[^a-z0-9+\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _plain(x: str) -> str:
    bare = rf"trim(regexp_replace(lower({x}), '\b\d+(?:\.\d+)*\b', '', 'g'))"
    return rf"trim(regexp_replace(regexp_replace({bare}, '( developer| engineer|\.js)$', ''), '\s+', ' ', 'g'))"


def _set(xs: str, norm=_norm) -> str:
    return f"list_distinct(list_filter(list_transform({xs}, lambda s: {norm('s')}), lambda s: s <> ''))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


REPEATED_SQL = "(len({t}) >= 12 AND coalesce(list_max(list_transform(list_distinct({w}), lambda x: len(list_filter({w}, lambda y: y = x)))), 0) >= 3)"
NEARBY_SQL = "(len({t}) >= 8 AND len(list_filter(range(1, len({t}) + 1), lambda i: length({t}[i]) >= 4 AND len(list_filter({t}[i:i + 7], lambda y: y = {t}[i])) >= 3)) > 0)"
TOKENS_SQL = "regexp_extract_all(lower({x}), '[a-z0-9'']+')"
WINDOWS_SQL = "list_transform(range(1, greatest(len({t}) - 8, 1)), lambda i: array_to_string({t}[i:i + 9], ' '))"
COUNT_SQL = "list_sum(list_transform({terms}, lambda w: (length({x}) - length(replace({x}, w, ''))) // length(w)))::INT"

#: Through label rows, as common table expressions.
LABELS_SQL = f"""WITH {PAIRS_SQL},
q1 AS (SELECT *, {_set('skills')} AS have, {_set('required')} AS need, list_filter(list_transform(required[1:3], lambda s: {_norm('s')}), lambda s: s <> '') AS core,
  lower(array_to_string(list_concat(CASE WHEN summary IS NULL THEN [] ELSE [summary] END, list_transform(range(1, len(titles) + 1), lambda i: titles[i] || chr(10) || stories[i]), skills), chr(10))) AS text,
  lower(array_to_string(titles, ' ')) AS all_titles, len(list_filter(levels, lambda x: x = 'expert')) AS experts FROM p),
q2 AS (SELECT *, {_jaccard('have', 'need')} AS overlap, {TOKENS_SQL.format(x='text')} AS words,
  CASE WHEN len(list_filter({_quoted(policy.EXECUTIVE_TITLES)}, lambda k: contains(all_titles, k))) > 0 THEN 'executive'
       WHEN len(list_filter({_quoted(policy.LEAD_TITLES)}, lambda k: contains(all_titles, k))) > 0 THEN 'lead'
       WHEN contains(all_titles, 'senior') OR years >= 5 THEN 'senior' WHEN years >= 2 THEN 'mid_level' ELSE 'entry_level' END AS resume_level,
  {COUNT_SQL.format(terms=_quoted(policy.BUZZWORDS), x='text')} AS buzzwords FROM q1),
q3 AS (SELECT *, {WINDOWS_SQL.format(t='words')} AS runs, list_position(['entry_level', 'mid_level', 'senior', 'lead', 'executive'], resume_level) AS have_score,
  list_position(['entry_level', 'mid_level', 'senior', 'lead', 'executive'], seniority) AS need_score FROM q2),
q4 AS (SELECT *, required_years <> 0 AND years < 0.5::DOUBLE * required_years AS experience_mismatch, abs(have_score - need_score) > 1 AS seniority_mismatch,
  len(list_filter(core, lambda s: NOT list_contains(have, s))) > 0 AS missing_core_skills,
  (resume_level = 'entry_level' AND (experts > 10 OR len(levels) > 20)) OR contains(text, 'expert in all') OR contains(text, 'certified in everything') AS hallucinated_skills,
  buzzwords > 5 OR {REPEATED_SQL.format(t='words', w='runs')} OR {NEARBY_SQL.format(t='words')} AS awkward_language FROM q3),
q5 AS (SELECT *, experience_mismatch::INT + seniority_mismatch::INT + missing_core_skills::INT + hallucinated_skills::INT + awkward_language::INT AS failure_count,
  CASE WHEN overlap >= 0.8::DOUBLE AND NOT missing_core_skills THEN 'excellent' WHEN overlap >= 0.6::DOUBLE THEN 'good' WHEN overlap >= 0.4::DOUBLE THEN 'partial' WHEN overlap >= 0.2::DOUBLE THEN 'poor' ELSE 'complete_mismatch' END AS fit,
  len(list_filter([0.8::DOUBLE, 0.6::DOUBLE, 0.4::DOUBLE, 0.2::DOUBLE], lambda b: abs(overlap - b) <= 0.03::DOUBLE)) > 0 AS near,
  ('0x' || sha256(trace_id)[1:8])::BIGINT / 4294967295::DOUBLE < 0.1::DOUBLE AS audit FROM q4),
q6 AS (SELECT *, list_filter([CASE WHEN fit_level <> fit THEN 'fit_label_mismatch' END, CASE WHEN fit = 'excellent' AND hallucinated_skills THEN 'excellent_with_hallucination' END, CASE WHEN near THEN 'near_fit_boundary' END,
  CASE WHEN fit_level = 'excellent' AND failure_count >= 2 THEN 'rule_conflict_profile' END, CASE WHEN awkward_language AND buzzwords <= 7 THEN 'ambiguous_language' END, CASE WHEN audit THEN 'random_audit' END], lambda c: c IS NOT NULL) AS codes FROM q5),
labels_ AS (SELECT seq, trace_id, fit_level AS generated_fit_label, fit AS computed_fit_label, round_even(overlap, 6) AS skills_overlap, experience_mismatch, seniority_mismatch, missing_core_skills, hallucinated_skills, awkward_language,
  failure_count, template AS resume_template, len(codes) > 0 AS requires_human_review, codes AS review_reason_codes, is_niche FROM q6)
"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.metrics(pairs(spark, sf_dir), AS_OF)


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label(pairs(spark, sf_dir), AS_OF)


def _of_metrics(name: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return measured(spark, sf_dir).select("trace_id", *(c.alias(n) for n, c in columns().items()))

    query(name, f"{LABELS_SQL} SELECT trace_id, {sql} FROM q6")(run)


_of_metrics("p01_normalized_skills", "array_to_string(list_sort(have), '|') AS have, array_to_string(list_sort(need), '|') AS need", lambda: dict(have=F.array_join(F.array_sort("have"), "|"), need=F.array_join(F.array_sort("need"), "|")))
_of_metrics("p03_jaccard", "overlap", lambda: dict(overlap=F.col("overlap")))
_of_metrics("p05_experience_years", "years", lambda: dict(years=F.col("years")))
_of_metrics("p06_resume_seniority", "resume_level AS seniority", lambda: dict(seniority=F.col("seniority")))
_of_metrics("p08_fit_level", "fit", lambda: dict(fit=F.col("fit")))
_of_metrics("p12_text_blob", "text", lambda: dict(text=F.col("text")))
_of_metrics("p13_near_boundary", "near", lambda: dict(near=L.near_boundary(F.col("overlap"))))
_of_metrics("p14_random_audit", "audit", lambda: dict(audit=L.audited(F.col("trace_id"))))
_of_metrics("p15_experience_mismatch", "experience_mismatch", lambda: dict(experience_mismatch=F.col("experience_mismatch")))
_of_metrics("p16_seniority_mismatch", "seniority_mismatch", lambda: dict(seniority_mismatch=F.col("seniority_mismatch")))
_of_metrics("p17_missing_core_skills", "missing_core_skills", lambda: dict(missing_core_skills=F.col("missing_core_skills")))
_of_metrics("p18_hallucinated_skills", "hallucinated_skills", lambda: dict(hallucinated_skills=F.col("hallucinated_skills")))
_of_metrics("p19_awkward_language", "awkward_language, buzzwords", lambda: dict(awkward_language=F.col("awkward_language"), buzzwords=F.col("buzzwords")))
_of_metrics("p20_failure_count", "failure_count", lambda: dict(failure_count=F.col("failure_count")))
_of_metrics("p21_reason_codes", "array_to_string(codes, ',') AS codes", lambda: dict(codes=F.array_join(L.reason_codes(), ",")))

_LABEL_COLUMNS = "trace_id, generated_fit_label, computed_fit_label, skills_overlap, experience_mismatch, seniority_mismatch, missing_core_skills, hallucinated_skills, awkward_language, failure_count, resume_template, requires_human_review"


@query("p22_label_rows", f"{LABELS_SQL} SELECT {_LABEL_COLUMNS}, array_to_string(review_reason_codes, ',') AS review_reason_codes FROM labels_")
def label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_rows(spark, sf_dir).withColumn("review_reason_codes", F.array_join("review_reason_codes", ","))


@query(
    "p23_adjudication",
    f"""{LABELS_SQL} SELECT trace_id, generated_fit_label, computed_fit_label, computed_fit_label AS adjudicated_fit_label, CASE WHEN requires_human_review THEN 'human_review' ELSE 'auto_accept' END AS adjudicator_type,
array_to_string(review_reason_codes, ',') AS reason_codes, CASE WHEN requires_human_review THEN 'a reviewer decides, for the reasons given' ELSE 'nothing asks for a review' END AS notes, 'benchmark_policy_v1' AS policy_id FROM labels_""",
)
def adjudication_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.adjudicate(label_rows(spark, sf_dir)).withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("p02_plain_skills", f"WITH {PAIRS_SQL} SELECT trace_id, array_to_string(list_transform(skills, lambda s: {_plain('s')}), '|') AS skills FROM p")
def plain_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("trace_id", F.array_join(F.transform("resume.skills", lambda s: plain_skill(s["name"])), "|").alias("skills"))


def _plain_overlap() -> Column:
    have = skill_set(F.transform("resume.skills", lambda s: s["name"]), plain_skill, keep_empty=True)
    return jaccard(have, skill_set(F.col("job_description.requirements.required_skills"), plain_skill, keep_empty=True))


PLAIN_SQL = f"WITH {PAIRS_SQL}, o AS (SELECT *, list_distinct(list_transform(skills, lambda s: {_plain('s')})) AS have, list_distinct(list_transform(required, lambda s: {_plain('s')})) AS need FROM p)"


@query("p04_plain_overlap", f"{PLAIN_SQL} SELECT trace_id, {_jaccard('have', 'need')} AS overlap FROM o")
def plain_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("trace_id", _plain_overlap().alias("overlap"))


@query("a10_overlap_by_fit", f"{PLAIN_SQL}, v AS (SELECT fit_level, {_jaccard('have', 'need')} AS overlap FROM o WHERE fit_level IS NOT NULL) SELECT fit_level, avg(overlap) AS mean_overlap, min(overlap) AS min_overlap, max(overlap) AS max_overlap FROM v GROUP BY fit_level")
def overlap_by_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).where("fit_level is not null").select("fit_level", _plain_overlap().alias("overlap"))
    return rows.groupBy("fit_level").agg(F.avg("overlap").alias("mean_overlap"), F.min("overlap").alias("min_overlap"), F.max("overlap").alias("max_overlap"))


#: Terms of the invented prose, as the policy's own hardly occur in it.
TEXT_TERMS = ("the", "tion", "que", "der", "idiot", "que la", "ing and")


@query("p09_buzzwords", f"SELECT doc_id, {COUNT_SQL.format(terms=_quoted(TEXT_TERMS), x='lower(text)')} AS n FROM documents")
def buzzwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", count_terms(F.col("text"), TEXT_TERMS).alias("n"))


@query("p10_repeated_windows", f"""WITH t AS (SELECT doc_id, {TOKENS_SQL.format(x='text')} AS t FROM documents),
w AS (SELECT doc_id, array_to_string(t[i:i + 9], ' ') AS g, count(*) AS n FROM t, unnest(range(1, len(t) - 8)) AS u(i) GROUP BY ALL)
SELECT doc_id, coalesce((SELECT max(n) FROM w WHERE w.doc_id = documents.doc_id), 0) >= 3 AS repeated FROM documents""")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", repeated_windows(tokens(F.col("text"))).alias("repeated"))


@query("p11_repeated_nearby", f"WITH t AS (SELECT doc_id, {TOKENS_SQL.format(x='text')} AS t FROM documents) SELECT doc_id, {NEARBY_SQL.format(t='t')} AS repeated FROM t")
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", repeated_nearby(tokens(F.col("text"))).alias("repeated"))


@query("p07_job_seniority", f"""WITH {PAIRS_SQL} SELECT trace_id, CASE WHEN regexp_matches(lower(coalesce(titles[1], '')), 'senior|lead|principal|staff|director|head|vp') THEN 'senior' WHEN required_years <= 1 THEN 'entry_level' WHEN required_years >= 5 THEN 'senior' ELSE 'mid_level' END AS level FROM p""")
def job_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairwright.operators.synthesis import infer_seniority

    title = F.coalesce(F.get(F.col("resume.experience"), 0)["position"], F.lit(""))
    return pairs(spark, sf_dir).select("trace_id", infer_seniority(title, F.col("job_description.requirements.years_experience")).alias("level"))


@query("p24_json_object", """WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here: ' || props || ' done.' WHEN 2 THEN 'no object' ELSE props[1:-2] END AS answer FROM events),
b AS (SELECT event_id, strpos(answer, '{') AS f, length(answer) - strpos(reverse(answer), '}') + 1 AS l, strpos(answer, '}') AS e, answer FROM a)
SELECT event_id, CASE WHEN f > 0 AND e > 0 AND l > f AND json_valid(answer[f:l]) THEN answer[f:l] END AS body FROM b""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, props = F.col("event_id") % 4, F.col("props")
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), props, F.lit(" done."))).when(k == 2, "no object").otherwise(F.substring(props, F.lit(1), F.length(props) - 1))
    return table(spark, sf_dir, "events").select("event_id", json_object(answer).alias("body"))
