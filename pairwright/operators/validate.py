"""Validation of JSON lines against the record schema: every rule is an expression over a VARIANT.

A rule holds a check and a reading. The check takes a field's value and its location and gives the array of its errors
(loc, type, msg); the reading gives the typed value of what the check accepts: texts that stand for numbers, booleans and
dates become those, and what is missing gets its default. A missing field is a null column, an explicit null a null variant.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.functions.text import once

Check = Callable[[Column, Column], Column]


class Origin(NamedTuple):
    """What defaults are made of: a text that tells the line from others, and the time of the run."""

    line: Column
    now: Column

    def id(self, role: str) -> Column:
        """The default id of one part of a line; the same line gives the same id."""
        return F.concat(F.lit("id-"), F.substring(F.sha2(F.concat_ws("|", F.lit(role), self.line), 256), 1, 32))


class Rule(NamedTuple):
    check: Check
    read: Callable[[Column, Origin], Column]
    whole: bool = False  # takes the record that the field is in, not the field


ERRORS = "array<struct<loc:string,type:string,msg:string>>"

# Calling codes of the regions that are known, with the digits of a national number.
REGIONS = {"US": ("1", 10, 10), "CA": ("1", 10, 10), "GB": ("44", 9, 10), "DE": ("49", 6, 11), "FR": ("33", 9, 9), "ES": ("34", 9, 9), "IN": ("91", 10, 10), "AU": ("61", 9, 9)}


def none() -> Column:
    return F.from_json(F.lit("[]"), ERRORS)


def one(loc: Column, kind: str, msg: Column | str) -> Column:
    return F.array(F.struct(loc.alias("loc"), F.lit(kind).alias("type"), (F.lit(msg) if isinstance(msg, str) else msg).alias("msg")))


def under(loc: Column, name: Column | str) -> Column:
    """A field's location; it begins with a dot, which ``validate`` takes off."""
    return F.concat(loc, F.lit("."), F.lit(name) if isinstance(name, str) else name.cast("string"))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, F.lit(f"$.{name}"), "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, OBJECT or ARRAY."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text(v: Column) -> Column:
    return F.try_variant_get(v, F.lit("$"), "string")


def string(least: int = 0, more: Callable[[Column, Column], Column] | None = None, read: Callable[[Column], Column] = lambda s: s) -> Rule:
    def check(v: Column, loc: Column) -> Column:
        out = F.when(kind(v) != "STRING", one(loc, "string_type", "Input should be a valid string"))
        if least:
            out = out.when(F.length(text(v)) < least, one(loc, "string_too_short", f"String should have at least {least} character{'s' * (least > 1)}"))
        return out.otherwise(more(text(v), loc) if more else none())

    return Rule(check, lambda v, _: read(text(v)))


def enum(values: tuple[str, ...]) -> Rule:
    listed = ", ".join(f"'{x}'" for x in values[:-1]) + f" or '{values[-1]}'"
    return Rule(lambda v, loc: F.when((kind(v) == "STRING") & text(v).isin(*values), none()).otherwise(one(loc, "enum", f"Input should be {listed}")), lambda v, _: text(v))


def _number(v: Column) -> Column:
    """The number that a variant is or stands for; null if none."""
    trimmed = F.regexp_replace(text(v), r"^\s+|\s+$", "")
    return F.when(kind(v) == "BOOLEAN", F.when(text(v) == "true", 1.0).otherwise(0.0)).when(kind(v) == "STRING", F.expr("0D") + trimmed.try_cast("double")).otherwise(F.try_variant_get(v, F.lit("$"), "double"))


def number(low: float, high: float, whole: bool) -> Rule:
    """A number, or a text or boolean that stands for one, within bounds."""

    def check(v: Column, loc: Column) -> Column:
        value = _number(v)
        name = "integer" if whole else "number"
        bad = (kind(v).isin("OBJECT", "ARRAY", "VOID"), (kind(v) == "STRING") & (~F.regexp_replace(text(v), r"^\s+|\s+$", "").rlike(r"^[+-]?\d+(?:\.0*)?$" if whole else r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")))
        out = F.when(bad[0], one(loc, "int_type" if whole else "float_type", f"Input should be a valid {name}"))
        out = out.when(bad[1], one(loc, "int_parsing" if whole else "float_parsing", f"Input should be a valid {name}, unable to parse string as {'an integer' if whole else 'a number'}"))
        if whole:
            out = out.when(value != F.floor(value), one(loc, "int_from_float", "Input should be a valid integer, got a number with a fractional part"))
        out = out.when(value < low, one(loc, "greater_than_equal", f"Input should be greater than or equal to {low:g}"))
        return out.when(value > high, one(loc, "less_than_equal", f"Input should be less than or equal to {high:g}")).otherwise(none())

    return Rule(check, lambda v, _: _number(v).cast("int") if whole else _number(v))


def boolean() -> Rule:
    on, off = ("true", "1", "1.0", "yes", "on", "t", "y"), ("false", "0", "0.0", "no", "off", "f", "n")

    def check(v: Column, loc: Column) -> Column:
        ok = (kind(v) == "BOOLEAN") | (kind(v).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE") & F.lower(text(v)).isin(*on, *off))
        return F.when(ok, none()).when(kind(v).isin("OBJECT", "ARRAY", "VOID"), one(loc, "bool_type", "Input should be a valid boolean")).otherwise(one(loc, "bool_parsing", "Input should be a valid boolean, unable to interpret input"))

    return Rule(check, lambda v, _: F.lower(text(v)).isin(*on))


def parsed_date(s: Column) -> Column:
    """A date, also from a midnight timestamp; null if it is none."""
    day = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})(?:[T ]00:00(?::00(?:\.0+)?)?(?:Z|\+00:?00)?)?$", 1)
    return F.when(day != "", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))


def date() -> Rule:
    def check(v: Column, loc: Column) -> Column:
        timed = F.try_to_timestamp(F.regexp_extract(text(v), r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*$", 0)).isNotNull()
        out = F.when(kind(v).isin("OBJECT", "ARRAY", "VOID", "BOOLEAN"), one(loc, "date_type", "Input should be a valid date"))
        out = out.when((kind(v) == "STRING") & parsed_date(text(v)).isNotNull(), none())
        out = out.when((kind(v) != "STRING") | timed, one(loc, "date_from_datetime_inexact", "Datetimes provided to dates should have zero time - e.g. be exact dates"))
        return out.otherwise(one(loc, "date_from_datetime_parsing", "Input should be a valid date or datetime, invalid character in year"))

    return Rule(check, lambda v, _: parsed_date(text(v)))


def timestamp() -> Rule:
    """A timestamp, or a number of seconds since 1970 (of milliseconds, if it is over 2e10)."""

    def check(v: Column, loc: Column) -> Column:
        ok = kind(v).isin("BIGINT", "DECIMAL", "DOUBLE") | ((kind(v) == "STRING") & text(v).rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(text(v)).isNotNull())
        return F.when(ok, none()).when(kind(v).isin("OBJECT", "ARRAY", "VOID", "BOOLEAN"), one(loc, "datetime_type", "Input should be a valid datetime")).otherwise(one(loc, "datetime_from_date_parsing", "Input should be a valid datetime or date, invalid character in year"))

    def read(v: Column, _: Origin) -> Column:
        n = F.try_variant_get(v, F.lit("$"), "double")
        return F.when(kind(v) == "STRING", F.try_to_timestamp(text(v))).otherwise(F.timestamp_seconds(F.when(F.abs(n) > 2e10, n / 1000).otherwise(n)))

    return Rule(check, read)


def items(rule: Rule, least: int = 0) -> Rule:
    def run(v: Column, loc: Column) -> Column:
        parts = F.try_variant_get(v, F.lit("$"), "array<variant>")
        inner = F.flatten(F.transform(parts, lambda x, i: rule.check(x, under(loc, i))))
        out = F.when(kind(v) != "ARRAY", one(loc, "list_type", "Input should be a valid list"))
        if least:
            out = out.when(F.size(parts) < least, F.concat(inner, one(loc, "too_short", F.concat(F.lit(f"List should have at least {least} item{'s' * (least > 1)} after validation, not "), F.size(parts).cast("string")))))
        return out.otherwise(inner)

    return Rule(run, lambda v, o: F.transform(F.try_variant_get(v, F.lit("$"), "array<variant>"), lambda x: rule.read(x, o)))


def required(rule: Rule) -> Rule:
    return Rule(lambda v, loc: F.when(v.isNull(), one(loc, "missing", "Field required")).otherwise(rule.check(v, loc)), rule.read)


def defaulted(rule: Rule, value: Callable[[Origin], Column]) -> Rule:
    """May be missing, but not null; then it has the value."""
    return Rule(lambda v, loc: F.when(v.isNull(), none()).otherwise(rule.check(v, loc)), lambda v, o: F.when(v.isNull(), value(o)).otherwise(rule.read(v, o)))


def optional(rule: Rule) -> Rule:
    return Rule(lambda v, loc: F.when(v.isNull() | F.is_variant_null(v), none()).otherwise(rule.check(v, loc)), lambda v, o: F.when(~(v.isNull() | F.is_variant_null(v)), rule.read(v, o)))


def record(name: str, fields: dict[str, Rule]) -> Rule:
    """An object; other keys are ignored. Its errors come in the order of its fields."""

    def check(v: Column, loc: Column) -> Column:
        parts = [r.check(v, loc) if r.whole else _bound(r.check, field(v, f), under(loc, f)) for f, r in fields.items()]
        return F.when(kind(v) != "OBJECT", one(loc, "model_type", f"Input should be a valid dictionary or instance of {name}")).otherwise(F.concat(*parts))

    def read(v: Column, o: Origin) -> Column:
        return F.struct(*((r.read(v, o) if r.whole else _read(r, field(v, f), o)).alias(f) for f, r in fields.items()))

    return Rule(check, read)


def _read(rule: Rule, v: Column, o: Origin) -> Column:
    return once(v, lambda x: rule.read(x, o))


def _bound(check: Check, v: Column, loc: Column) -> Column:
    return once(v, lambda x: check(x, loc))


_LABEL = r"[A-Za-z0-9\x{80}-\x{10FFFF}](?:[A-Za-z0-9\x{80}-\x{10FFFF}-]{0,61}[A-Za-z0-9\x{80}-\x{10FFFF}])?"
EMAIL = rf"^[A-Za-z0-9.!#$%&'*+/=?^_`{{|}}~\x{{80}}-\x{{10FFFF}}-]{{1,64}}@{_LABEL}(?:\.{_LABEL})+$"
# Names of the domain system that no mail is sent to.
SPECIAL_DOMAINS = ("arpa", "invalid", "local", "localhost", "onion", "test")


def normal_email(s: Column) -> Column:
    """The address in lower case; null if it is none, or one of a domain set aside for other uses. Letters of any script may
    stand in it, but white space and control characters may not."""
    fine = s.rlike(EMAIL) & ~s.rlike(r"(?U)^\.|\.@|\.\.|\s|\p{Cntrl}|[.][0-9]+$") & ~F.lower(s).rlike(rf"\.(?:{'|'.join(SPECIAL_DOMAINS)})$")
    return F.when(fine, F.lower(s))


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def normal_phone(s: Column, region: Column) -> Column:
    """E.164 form of a number, with its own + code or that of its region; null if it is none."""
    s = _trimmed(s)
    digits = F.regexp_replace(s, r"[^0-9]", "")
    clean = ~s.rlike("[A-Za-z]") & s.rlike(r"^\+?[0-9().\s/-]+$")
    code = F.element_at(F.create_map(*(F.lit(x) for k, v in REGIONS.items() for x in (k, v[0]))), region)
    low, high = (F.element_at(F.create_map(*(F.lit(x) for k, v in REGIONS.items() for x in (k, v[i]))), region) for i in (1, 2))
    national = F.regexp_replace(digits, "^0+", "")
    known = F.lit(None).cast("string")
    for c, a, b in sorted(set(REGIONS.values())):
        known = F.when(digits.rlike(f"^{c}[0-9]{{{a},{b}}}$"), digits).otherwise(known)
    own = F.when(known.isNotNull(), F.concat(F.lit("+"), known))
    return F.when(~clean, None).when(F.startswith(s, F.lit("+")), own).when(F.length(national).between(low, high), F.concat(F.lit("+"), code, national)).when(F.startswith(digits, code) & F.length(digits).between(low + F.length(code), high + F.length(code)), F.concat(F.lit("+"), digits))


def normal_region(s: Column) -> Column:
    code = F.upper(_trimmed(s))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def _email(s: Column, loc: Column) -> Column:
    return F.when(normal_email(s).isNull(), one(loc, "value_error", "value is not a valid email address")).otherwise(none())


def _region(s: Column, loc: Column) -> Column:
    return F.when(normal_region(s).isNull(), one(loc, "value_error", "Value error, phone_region must be a 2-letter ISO country code")).otherwise(none())


def _phone(v: Column, loc: Column) -> Column:
    """The phone sees the region only if that is valid by itself."""
    number_, at = field(v, "phone"), under(loc, "phone")
    region = normal_region(text(field(v, "phone_region")))
    bad = one(at, "value_error", "Value error, Invalid phone number format")
    needed = one(at, "value_error", "Value error, phone_region is required for numbers without a country code")
    out = F.when(number_.isNull(), one(at, "missing", "Field required")).when(kind(number_) != "STRING", one(at, "string_type", "Input should be a valid string"))
    return out.when(text(number_).rlike("[A-Za-z]"), bad).when(~F.startswith(_trimmed(text(number_)), F.lit("+")) & region.isNull(), needed).when(normal_phone(text(number_), region).isNull(), bad).otherwise(none())


def _dates(v: Column, loc: Column) -> Column:
    start, end = (parsed_date(text(field(v, f))) for f in ("start_date", "end_date"))
    return F.when(end <= start, one(under(loc, "end_date"), "value_error", "Value error, end_date must be after start_date")).otherwise(none())


def _phone_read(v: Column, _: Origin) -> Column:
    return normal_phone(text(field(v, "phone")), normal_region(text(field(v, "phone_region"))))


def _end_check(v: Column, loc: Column) -> Column:
    return F.concat(_bound(_END.check, field(v, "end_date"), under(loc, "end_date")), _dates(v, loc))


_END = optional(date())
_TEXTS = lambda _: F.array().cast("array<string>")
_NOW = lambda o: o.now
_NO = lambda _: F.lit(False)

CONTACT = record("ContactInfo", {"name": required(string(2)), "email": required(string(0, _email, normal_email)), "phone_region": optional(string(0, _region, normal_region)), "phone": Rule(_phone, _phone_read, True), "location": required(string(3))})
EDUCATION = record("Education", {"institution": required(string(3)), "degree": required(string(3)), "field_of_study": required(string(3)), "graduation_year": optional(number(1950, 2030, True)), "gpa": optional(number(0, 4, False))})
EXPERIENCE = record("Experience", {"company": required(string(2)), "position": required(string(2)), "start_date": required(date()), "end_date": Rule(_end_check, lambda v, o: _END.read(field(v, "end_date"), o), True), "description": required(string(20)), "achievements": defaulted(items(string()), _TEXTS)})
SKILL = record("Skill", {"name": required(string(2)), "category": required(string(3)), "proficiency": required(enum(policy.PROFICIENCIES))})
RESUME_METADATA = record("ResumeMetadata", {"trace_id": defaulted(string(3), lambda o: o.id("resume")), "generated_at": defaulted(timestamp(), _NOW), "prompt_template": defaulted(string(3), lambda _: F.lit("baseline_v1")), "fit_level": optional(enum(policy.FIT_LEVELS)), "writing_style": defaulted(string(3), lambda _: F.lit("professional")), "used_fallback": defaulted(boolean(), _NO)})
RESUME = record("Resume", {"contact_info": required(CONTACT), "education": required(items(EDUCATION, 1)), "experience": required(items(EXPERIENCE, 1)), "skills": required(items(SKILL, 3)), "metadata": defaulted(RESUME_METADATA, lambda o: RESUME_METADATA.read(F.parse_json(F.lit("{}")), o)), "summary": optional(string(20))})
REQUIREMENTS = record("JobRequirements", {"required_skills": required(items(string(), 1)), "preferred_skills": defaulted(items(string()), _TEXTS), "experience_level": required(enum(policy.SENIORITIES)), "education_requirements": required(string(5)), "years_experience": optional(number(0, 30, True))})
JOB_METADATA = record("JobMetadata", {"trace_id": defaulted(string(3), lambda o: o.id("job")), "generated_at": defaulted(timestamp(), _NOW), "is_niche_role": defaulted(boolean(), _NO), "used_fallback": defaulted(boolean(), _NO)})
JOB = record(
    "JobDescription",
    {"company": required(string(2)), "industry": required(string(2)), "company_size": required(string(2)), "position": required(string(2)), "location": required(string(3)), "description": required(string(50)), "requirements": required(REQUIREMENTS), "metadata": required(JOB_METADATA), "salary_range": optional(string(5)), "benefits": optional(items(string()))},
)
PAIR = record("ResumeJobPair", {"resume": required(RESUME), "job_description": required(JOB), "fit_level": optional(enum(policy.FIT_LEVELS)), "trace_id": defaulted(string(3), lambda o: o.id("pair")), "analysis_date": defaulted(timestamp(), _NOW)})
RECORDS = {"resumes": RESUME, "jobs": JOB, "pairs": PAIR}


def category(error: Column) -> Column:
    """One of the five categories, by type, then message and location."""
    kind_, msg, loc = error["type"], F.lower(error["msg"]), F.lower(error["loc"])
    return (
        F.when((kind_ == "missing") | F.contains(msg, F.lit("field required")), "missing_required_fields")
        .when((kind_ == "enum") | (F.contains(msg, F.lit("input should be")) & (F.contains(msg, F.lit("'")) | F.contains(msg, F.lit("enum")))), "enum_mapping_failures")
        .when(kind_.isin("greater_than", "greater_than_equal", "less_than", "less_than_equal") | msg.rlike("must be after|must be greater than"), "logical_inconsistencies")
        .when(kind_.isin("date_parsing", "datetime_parsing", "time_parsing", "string_pattern_mismatch", "json_invalid") | msg.rlike("invalid phone number format|valid email address") | (F.contains(msg, F.lit("format")) & loc.rlike("email|phone|date")), "format_violations")
        .otherwise("type_mismatches")
    )


def _shown(loc: Column) -> Column:
    return F.when(loc == "", "__root__").otherwise(F.regexp_replace(loc, "^[.]", ""))


@lru_cache(maxsize=1)
def _rules(gateway: int) -> Column:
    """All errors of (record_type, value); building so large an expression takes seconds, so it is kept for the JVM."""
    parsed = F.try_parse_json("value")
    found = F.when(parsed.isNull(), one(F.lit(""), "json_invalid", "Invalid JSON"))
    for name, check in RECORDS.items():
        found = found.when(F.col("record_type") == name, _bound(check.check, parsed, F.lit("")))
    return F.transform(F.coalesce(found, none()), lambda e: F.struct(_shown(e["loc"]).alias("loc"), e["type"].alias("type"), e["msg"].alias("msg"), category(e).alias("category")))


def validate(lines: DataFrame) -> DataFrame:
    """Adds errors (loc, type, msg, category), error_count and error_categories to rows of (record_type, value).

    Each type of record is parsed and checked once, in a branch of its own. A line that isn't JSON has one error at
    __root__. Null and blank lines must be left out before. No row is moved: this is one projection.
    """
    out = lines.withColumn("errors", _rules(id(SparkContext._gateway)))
    return out.withColumns({"error_count": F.size("errors"), "error_categories": F.array_sort(F.array_distinct(F.transform("errors", lambda e: e["category"])))})


def summary(checked: DataFrame) -> DataFrame:
    """One row: lines, valid and invalid ones, success rate (0 for none)."""
    return checked.agg(F.count("*").alias("total"), F.count_if(F.col("error_count") == 0).alias("valid"), F.count_if(F.col("error_count") > 0).alias("invalid"), F.coalesce(F.avg((F.col("error_count") == 0).cast("double")), F.lit(0.0)).alias("success_rate"))


def distribution(checked: DataFrame) -> DataFrame:
    """(category, count) of all errors; all five categories, zeros included."""
    counts = checked.select(F.explode("errors.category").alias("category")).groupBy("category").count()
    every = checked.sparkSession.createDataFrame([(c,) for c in policy.ERROR_CATEGORIES], "category string")
    return every.join(counts, "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("count"))


def examples(checked: DataFrame, order: list[str], most: int = 5) -> DataFrame:
    """The first ``most`` errors of each category by ``order`` and place in the record.

    The limit on the row number is applied to each task's rows before they are shuffled.
    """
    each = checked.select(*order, F.posexplode("errors").alias("pos", "e")).select(*order, "pos", "e.*")
    w = Window.partitionBy("category").orderBy(*order, "pos")
    return each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid records."""
    return checked.where("error_count = 0"), checked.where("error_count > 0")


def typed(lines: DataFrame, record_type: str, now: str | None = None) -> DataFrame:
    """Adds record, the typed value of each line (value) of one type; the lines must be valid.

    Numbers, booleans, dates and timestamps given as texts are converted, contacts normalised, and what is missing gets its
    default: False, the first template and style, no texts, the time of the run (``now``), and ids made from source_file
    and line_number where the lines have them, else from their text, so that they are the same on each run.
    """
    line = F.concat_ws(":", "source_file", F.col("line_number").cast("string")) if {"source_file", "line_number"} <= set(lines.columns) else F.sha2("value", 256)
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    rule = RECORDS[record_type]
    return lines.withColumn("record", once(F.try_parse_json("value"), lambda v: once(line, lambda x: rule.read(v, Origin(x, at)))))
