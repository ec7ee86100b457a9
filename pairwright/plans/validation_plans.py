"""Queries of validation, over JSON lines made from customers with known damage."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.operators import validate as V
from pairwright.sources.stand_ins import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


RESUME = {
    "contact_info": {"name": "Jo Kim", "email": "Jo.Kim@K@@Example.com", "phone_region": " us", "phone": "(202) 555-0143", "location": "Remote"},
    "education": [{"institution": "State University", "degree": "BSc", "field_of_study": "Systems", "graduation_year": "2015", "gpa": 3.3}],
    "experience": [{"company": "Northstar", "position": "Analyst", "start_date": "2020-01-15", "end_date": None, "description": "Did work of several kinds for a team.", "achievements": ["One"]}, {"company": "Acme", "position": "Intern", "start_date": "2018-01-15T00:00:00", "end_date": "2019-06-30", "description": "Did work of several kinds for a team."}],
    "skills": [{"name": n, "category": "General", "proficiency": "expert"} for n in ("Python", "SQL", "Docker")],
    "summary": "A summary that is long enough to pass.",
    "other": 1,
}
JOB = {
    "company": "Northstar", "industry": "FinTech", "company_size": "50-100", "position": "Engineer @K@", "location": "Remote", "description": "An engineer who does a number of things that take more than fifty letters to say.",
    "requirements": {"required_skills": ["Python"], "preferred_skills": [], "experience_level": "senior", "education_requirements": "Degree", "years_experience": 5.0}, "metadata": {"is_niche_role": "yes"}, "benefits": None,
}


def _damaged(base: dict, path: tuple, value: object) -> dict:
    """A copy with one field set, or gone if the value is ``...``."""
    out = copy.deepcopy(base)
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


# (path, value, errors as location, type, category)
RESUME_DAMAGE = [
    (("contact_info", "email"), ..., [("contact_info.email", "missing", "missing_required_fields")]),
    (("contact_info", "email"), "jo at example", [("contact_info.email", "value_error", "format_violations")]),
    (("contact_info", "phone"), "call me", [("contact_info.phone", "value_error", "format_violations")]),
    (("education", 0, "gpa"), 4.7, [("education.0.gpa", "less_than_equal", "logical_inconsistencies")]),
    (("skills",), RESUME["skills"][:2], [("skills", "too_short", "type_mismatches")]),
    (("skills", 1, "proficiency"), "guru", [("skills.1.proficiency", "enum", "enum_mapping_failures")]),
    (("experience", 1, "end_date"), "2017-01-01", [("experience.1.end_date", "value_error", "logical_inconsistencies")]),
    (("experience", 0, "start_date"), "yesterday", [("experience.0.start_date", "date_from_datetime_parsing", "type_mismatches")]),
    (("summary",), "short", [("summary", "string_too_short", "type_mismatches")]),
    (("contact_info", "name"), 5, [("contact_info.name", "string_type", "type_mismatches")]),
    (("education", 0, "graduation_year"), "20x5", [("education.0.graduation_year", "int_parsing", "type_mismatches")]),
    (("contact_info", "phone_region"), "USA", [("contact_info.phone_region", "value_error", "type_mismatches"), ("contact_info.phone", "value_error", "type_mismatches")]),
    (("skills",), {}, [("skills", "list_type", "type_mismatches")]),
    (("education", 0, "graduation_year"), 1900, [("education.0.graduation_year", "greater_than_equal", "logical_inconsistencies")]),
    (("experience", 0, "start_date"), "2020-01-15T10:30:00", [("experience.0.start_date", "date_from_datetime_inexact", "type_mismatches")]),
]
JOB_DAMAGE = [
    (("company",), ..., [("company", "missing", "missing_required_fields")]),
    (("description",), "too short", [("description", "string_too_short", "type_mismatches")]),
    (("requirements", "experience_level"), "boss", [("requirements.experience_level", "enum", "enum_mapping_failures")]),
    (("requirements", "years_experience"), 44, [("requirements.years_experience", "less_than_equal", "logical_inconsistencies")]),
    (("requirements", "required_skills"), [], [("requirements.required_skills", "too_short", "type_mismatches")]),
    (("benefits",), "x", [("benefits", "list_type", "type_mismatches")]),
    (("metadata",), ..., [("metadata", "missing", "missing_required_fields")]),
    (("requirements", "years_experience"), 2.5, [("requirements.years_experience", "int_from_float", "type_mismatches")]),
    (("metadata", "is_niche_role"), "maybe", [("metadata.is_niche_role", "bool_parsing", "type_mismatches")]),
    (("requirements", "required_skills"), ["Python", 3], [("requirements.required_skills.1", "string_type", "type_mismatches")]),
    (("metadata",), None, [("metadata", "model_type", "type_mismatches")]),
]


# What a text model may write: numbers, flags and dates as texts, and no ids, times, template or style.
LAX_PAIR = {
    "resume": _damaged(_damaged(_damaged(RESUME, ("education", 0, "gpa"), " 3.5 "), ("contact_info", "phone"), " +1 202 555 0143"), ("metadata",), {"used_fallback": "yes"}),
    "job_description": _damaged(_damaged(JOB, ("requirements", "years_experience"), "8"), ("requirements", "preferred_skills"), ...), "analysis_date": 1704103200,
}


def _cases() -> list[tuple[str, str, list]]:
    """(record type, JSON text, errors) of every kind of line; a line's kind is its customer's number modulo their count."""
    out: list[tuple[str, str, list]] = []
    pair = {"resume": RESUME, "job_description": JOB, "fit_level": "good", "trace_id": "pair-@K@", "analysis_date": "2024-01-01T10:00:00Z"}
    for kind, base in (("resumes", RESUME), ("jobs", JOB), ("pairs", pair)):
        out += [(kind, json.dumps(base), []), (kind, json.dumps(base)[:-9], [("__root__", "json_invalid", "format_violations")]), (kind, "[1]", [("__root__", "model_type", "type_mismatches")])]
    out += [("resumes", json.dumps(_damaged(RESUME, p, v)), e) for p, v, e in RESUME_DAMAGE]
    out += [("jobs", json.dumps(_damaged(JOB, p, v)), e) for p, v, e in JOB_DAMAGE]
    for under, base, damage in (("resume", RESUME, RESUME_DAMAGE), ("job_description", JOB, JOB_DAMAGE)):
        out += [("pairs", json.dumps(pair | {under: _damaged(base, p, v)}), [(f"{under}.{loc}", t, c) for loc, t, c in e]) for p, v, e in damage[::3]]
    out += [("pairs", json.dumps(LAX_PAIR), []), ("pairs", json.dumps(_damaged(LAX_PAIR, ("job_description", "requirements", "years_experience"), True)), [])]
    out += [("resumes", json.dumps(_damaged(_damaged(RESUME, ("contact_info", "location"), "x"), ("contact_info", "phone"), "call me")), [("contact_info.phone", "value_error", "format_violations"), ("contact_info.location", "string_too_short", "type_mismatches")])]
    out += [("resumes", json.dumps(_damaged(_damaged(RESUME, ("experience", 1, "end_date"), "2017-01-01"), ("experience", 1, "description"), "x")), [("experience.1.end_date", "value_error", "logical_inconsistencies"), ("experience.1.description", "string_too_short", "type_mismatches")])]
    out += [("pairs", json.dumps(pair | {"fit_level": "great", "trace_id": "x"}), [("fit_level", "enum", "enum_mapping_failures"), ("trace_id", "string_too_short", "type_mismatches")]), ("pairs", json.dumps(pair | {"analysis_date": "noon"}), [("analysis_date", "datetime_from_date_parsing", "type_mismatches")])]
    return out


CASES = _cases()
N = len(CASES)
#: What valid pairs are read as, by their case: id given, gpa, years asked, niche, fallback, template, number of preferred skills, date.
TYPED = {
    next(i for i, (t, v, e) in enumerate(CASES) if t == "pairs" and not e): (True, 3.3, 5, True, False, "baseline_v1", 0, "2024-01-01 10:00:00"),
    next(i for i, (t, v, e) in enumerate(CASES) if v == json.dumps(LAX_PAIR)): (False, 3.5, 8, True, True, "baseline_v1", 0, "2024-01-01 10:00:00"),
    next(i for i, (t, v, e) in enumerate(CASES) if v == json.dumps(LAX_PAIR)) + 1: (False, 3.5, 1, True, True, "baseline_v1", 0, "2024-01-01 10:00:00"),
}
TYPED_SQL = "typed(c, given, gpa, years, niche, fallback, template, n_preferred, date) AS (VALUES " + ", ".join(f"({c}, {g}, {gpa}::DOUBLE, {y}, {n}, {f}, '{t}', {m}, TIMESTAMP '{d}')" for c, (g, gpa, y, n, f, t, m, d) in TYPED.items()) + ")"
EXPECTED_SQL = (
    f"WITH kinds(c, record_type) AS (VALUES {', '.join(f"({i}, '{t}')" for i, (t, _, _) in enumerate(CASES))}), "
    f"faults(c, pos, loc, type, category) AS (VALUES {', '.join(f"({i}, {j}, '{loc}', '{t}', '{cat}')" for i, (_, _, e) in enumerate(CASES) for j, (loc, t, cat) in enumerate(e))}), "
    f"lines AS (SELECT c_custkey AS k, record_type, c_custkey % {N} AS c FROM customer JOIN kinds ON c = c_custkey % {N}), "
    "errors AS (SELECT k, record_type, pos, loc, type, category FROM lines JOIN faults USING (c))"
)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, record_type, value): one line for every customer."""
    at = (F.col("c_custkey") % N).cast("int")
    kinds, texts = (F.array(*(F.lit(c[i]) for c in CASES)) for i in (0, 1))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.get(kinds, at).alias("record_type"), F.replace(F.get(texts, at), F.lit("@K@"), F.col("c_custkey").cast("string")).alias("value"))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(raw_lines(spark, sf_dir))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("k", "record_type", F.posexplode("errors").alias("pos", "e")).select("k", "record_type", "pos", "e.loc", "e.type", "e.category")


@query("v01_malformed_lines", f"{EXPECTED_SQL} SELECT k, record_type FROM errors WHERE type = 'json_invalid'")
def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).where("type = 'json_invalid'").select("k", "record_type")


@query("v02_errors", f"{EXPECTED_SQL} SELECT k, record_type, loc, type FROM errors")
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("k", "record_type", "loc", "type")


@query("v03_type_errors", f"{EXPECTED_SQL} SELECT k, loc, type FROM errors WHERE type LIKE '%_type' OR type LIKE '%parsing' OR type = 'missing'")
def type_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).where("type like '%_type' or type like '%parsing' or type = 'missing'").select("k", "loc", "type")


@query("v04_emails", "WITH e AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Jo.' || c_custkey || '@Example.COM' WHEN 1 THEN 'no address ' || c_custkey ELSE 'a..b@x.org' END AS email FROM customer) SELECT k, CASE WHEN k % 3 = 0 THEN lower(email) END AS email FROM e")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    email = F.when(k % 3 == 0, F.concat(F.lit("Jo."), k.cast("string"), F.lit("@Example.COM"))).when(k % 3 == 1, F.concat(F.lit("no address "), k.cast("string"))).otherwise("a..b@x.org")
    return table(spark, sf_dir, "customer").select(k.alias("k"), V.normal_email(email).alias("email"))


@query("v05_phones", "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '+1202555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN '+44207946' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 2 THEN '+1202555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone FROM customer")
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    last = F.lpad((k % 10000).cast("string"), 4, "0")
    phone = F.when(k % 5 == 0, F.concat(F.lit("(202) 555-"), last)).when(k % 5 == 1, F.concat(F.lit("020 7946 "), last)).when(k % 5 == 2, F.concat(F.lit("+1 202 555 "), last)).when(k % 5 == 3, "12").otherwise("call me")
    region = F.when(k % 5 == 1, "GB").when(k % 5 == 0, "US").otherwise("DE")
    return table(spark, sf_dir, "customer").select(k.alias("k"), V.normal_phone(phone, region).alias("phone"))


@query("v06_date_order", f"{EXPECTED_SQL} SELECT k, loc FROM errors WHERE loc LIKE '%end_date'")
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).where("loc like '%end_date'").select("k", "loc")


@query("v07_categories", f"{EXPECTED_SQL} SELECT k, loc, category FROM errors")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("k", "loc", "category")


@query("v08_record_categories", f"{EXPECTED_SQL} SELECT k, count(*)::INT AS error_count, string_agg(DISTINCT category, ',' ORDER BY category) AS error_categories FROM errors GROUP BY k")
def record_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.split(checked(spark, sf_dir))[1].select("k", "error_count", F.array_join("error_categories", ",").alias("error_categories"))


@query("v09_valid_contacts", f"{EXPECTED_SQL} SELECT k, 'jo.kim' || k || '@example.com' AS email, 'US' AS phone_region, '+12025550143' AS phone FROM lines WHERE record_type = 'resumes' AND k NOT IN (SELECT k FROM errors)")
def valid_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = V.split(checked(spark, sf_dir))[0].where("record_type = 'resumes'")
    return V.typed(valid, "resumes").select("k", F.col("record.contact_info").alias("c")).select("k", "c.email", "c.phone_region", "c.phone")


def typed_columns(pairs: DataFrame) -> DataFrame:
    """What TYPED states of typed pairs, with the pair's and the job's default ids of their lines."""
    metadata = F.col("resume.metadata")
    return pairs.select(
        "k", F.when(~F.startswith("trace_id", F.lit("id-")), F.col("trace_id")).alias("given_id"), (F.length("trace_id") > 3).alias("has_id"), F.get("resume.education", 0)["gpa"].alias("gpa"), F.col("job_description.requirements.years_experience").alias("years"),
        F.col("job_description.metadata.is_niche_role").alias("niche"), metadata["used_fallback"].alias("fallback"), metadata["prompt_template"].alias("template"), F.size("job_description.requirements.preferred_skills").alias("n_preferred"),
        F.col("analysis_date").cast("timestamp_ntz").alias("date"), (metadata["generated_at"] == F.lit("2024-05-05").cast("timestamp")).alias("stamped"), F.get("resume.experience", 1)["start_date"].alias("first_day"), F.col("resume.contact_info.phone").alias("phone"), F.get("resume.education", 0)["graduation_year"].alias("graduated"),
    )


TYPED_ROWS_SQL = "SELECT k, CASE WHEN given THEN 'pair-' || k END AS given_id, true AS has_id, gpa, years, niche, fallback, template, n_preferred, date, true AS stamped, DATE '2018-01-15' AS first_day, '+12025550143' AS phone, 2015 AS graduated FROM lines JOIN typed USING (c)"


@query("v09_typed_pairs", f"{EXPECTED_SQL}, {TYPED_SQL} {TYPED_ROWS_SQL}")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = V.split(checked(spark, sf_dir))[0].where("record_type = 'pairs'")
    return typed_columns(V.typed(valid, "pairs", "2024-05-05").select("k", "record.*"))


@query("v10_summary", f"{EXPECTED_SQL} SELECT count(*) AS total, count(*) FILTER (k NOT IN (SELECT k FROM errors)) AS valid, count(*) FILTER (k IN (SELECT k FROM errors)) AS invalid, avg((k NOT IN (SELECT k FROM errors))::INT::DOUBLE) AS success_rate FROM lines")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(checked(spark, sf_dir))


@query("v11_distribution", f"{EXPECTED_SQL} SELECT category, (SELECT count(*) FROM errors WHERE errors.category = c.category) AS count FROM unnest([{', '.join(f"'{c}'" for c in policy.ERROR_CATEGORIES)}]) AS c(category)")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.distribution(checked(spark, sf_dir))


@query("v12_examples", f"{EXPECTED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k, pos) AS n FROM errors) SELECT category, n, k, loc, type FROM n WHERE n <= 5")
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.examples(checked(spark, sf_dir), ["k"]).select("category", "n", "k", "loc", "type")
