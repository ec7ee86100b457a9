"""Queries of sources, sinks, streams and user functions, over data written from the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.operators import correction as C
from pairwright.operators import judge as J
from pairwright.operators import validate as V
from pairwright.operators.labels import label, metrics
from pairwright.operators.reports import last_per
from pairwright.plans.labelling import LABELS_SQL, label_rows
from pairwright.plans.validation_plans import EXPECTED_SQL, JOB, TYPED_SQL, raw_lines
from pairwright.sources import records as S
from pairwright.sources.stand_ins import AS_OF, PAIRS_SQL, pairs, table
from pairwright.streaming import rescored as RS
from pairwright.streaming import review as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def fresh(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return f"{S.shared_folder(spark)}/{uuid.uuid4().hex}"


def written_lines(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("jobs", "resumes", "pairs")) -> str:
    """Customers' lines as files of their record type, with a blank line after each tenth."""
    folder = fresh(spark)
    rows = raw_lines(spark, sf_dir)
    for kind in kinds:
        lines = rows.where(F.col("record_type") == kind).select(F.explode(F.when(F.col("k") % 10 == 0, F.array("value", F.lit(""))).otherwise(F.array("value"))).alias("value"))
        lines.write.text(f"{folder}/{kind}_v1.jsonl")
    rows.select("value").write.text(f"{folder}/other.jsonl")
    return folder


@query("s2_record_types", f"{EXPECTED_SQL} SELECT record_type, count(*) AS n FROM lines GROUP BY 1")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.record_lines(spark, written_lines(spark, sf_dir)).groupBy("record_type").agg(F.count("*").alias("n"))


@query("s3_line_numbers", f"{EXPECTED_SQL} SELECT record_type, count(*) AS n, count(*) + count(*) FILTER (k % 10 = 0) AS numbered, count(*) AS placed FROM lines GROUP BY 1")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type is written in order as several files, a blank line before each tenth customer's. numbered: the files' last
    numbers; placed: lines whose number is one more than, or beyond a blank line two more than, that of the line before."""
    folder = fresh(spark)
    rows = raw_lines(spark, sf_dir)
    for kind in ("jobs", "resumes", "pairs"):
        lines = rows.where(F.col("record_type") == kind).select("k", F.posexplode(F.when(F.col("k") % 10 == 0, F.array(F.lit(""), "value")).otherwise(F.array("value"))).alias("pos", "value"))
        lines.repartitionByRange(4, "k").sortWithinPartitions("k", "pos").select("value").write.text(f"{folder}/{kind}_v1.jsonl")
    numbered = S.record_lines(spark, folder)
    step = F.col("line_number") - F.coalesce(F.lag("line_number").over(Window.partitionBy("file_path").orderBy("line_number")), F.lit(0))
    files = numbered.withColumn("step", step).groupBy("record_type", "file_path").agg(F.count("*").alias("n"), F.max("line_number").alias("last"), F.count_if(F.col("step").isin(1, 2)).alias("placed"))
    return files.groupBy("record_type").agg(F.sum("n").alias("n"), F.sum("last").alias("numbered"), F.sum("placed").alias("placed"))


@query("s1_strict_pairs", f"{EXPECTED_SQL}, {TYPED_SQL} SELECT CASE WHEN given THEN 'pair-' || k ELSE 'default' END AS trace_id, CASE WHEN given THEN 'good' END AS fit_level, gpa, years FROM lines JOIN typed USING (c)")
def strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark)
    good = V.split(V.validate(raw_lines(spark, sf_dir).where("record_type = 'pairs'")))[0]
    good.select("value").write.text(f"{folder}/pairs_v1.jsonl")
    pairs = S.strict_pairs(V.validate(S.record_lines(spark, folder)))
    named = F.when(F.col("trace_id").rlike("^id-[0-9a-f]{32}$"), "default").otherwise(F.col("trace_id"))
    return pairs.select(named.alias("trace_id"), "fit_level", F.get("resume.education", 0)["gpa"].alias("gpa"), F.col("job_description.requirements.years_experience").alias("years"))


@query("s4_valid_pairs", f"{EXPECTED_SQL}, {TYPED_SQL} SELECT k, 'Engineer ' || k AS position, given, years > 2 AS experience_mismatch, 'baseline_v1' AS template FROM lines JOIN typed USING (c)")
def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed pairs, and the label row that follows from them: with 1.45 years, half of what is asked is less up to 2."""
    path = S.write_records(V.split(V.validate(raw_lines(spark, sf_dir)))[0].select("k", "record_type", "value"), fresh(spark), "1")
    pairs = S.typed_pairs(spark.read.parquet(path).where("record_type = 'pairs'"))
    flags = label(pairs, AS_OF).select("trace_id", "experience_mismatch", F.col("resume_template").alias("template"))
    return pairs.select("trace_id", "k", F.col("job_description.position").alias("position")).join(flags, "trace_id").select("k", "position", (~F.startswith("trace_id", F.lit("id-"))).alias("given"), "experience_mismatch", "template")


@query("s4_one_document", f"{EXPECTED_SQL}, {TYPED_SQL} SELECT k, 'Engineer ' || k AS position, years, 2 AS forms FROM lines JOIN typed USING (c)")
def one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid pairs handed over as one document for each thousand customers, and as lines: both forms give equal pairs."""
    folder = fresh(spark)
    good = V.split(V.validate(raw_lines(spark, sf_dir).where("record_type = 'pairs'")))[0].select("k", "record_type", "value")
    parts = good.groupBy(F.floor(F.col("k") / 1000).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",\n").alias("records"))
    documents = parts.select("part", F.concat(F.lit('{"summary": {"valid_records": 1},\n "records": {"jobs": [], "pairs": [\n'), "records", F.lit("\n]}}")).alias("value"))
    documents.repartition("part").write.partitionBy("part").text(f"{folder}/documents")  # one file a part
    whole = S.document_records(spark, f"{folder}/documents")
    good.select("value").write.text(f"{folder}/lines/pairs_v1.jsonl")
    told = [S.strict_pairs(V.validate(rows)) for rows in (whole, S.record_lines(spark, f"{folder}/lines"))]
    each = [t.select(F.substring_index("job_description.position", " ", -1).cast("long").alias("k"), F.col("job_description.position").alias("position"), F.col("job_description.requirements.years_experience").alias("years")) for t in told]
    return each[0].unionByName(each[1]).groupBy("k", "position", "years").agg(F.count("*").alias("forms"))


@query("s5_latest_run", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey % 3 = 2 GROUP BY 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark)
    for run in range(3):
        S.write_records(table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == run), folder, f"2024010{run}")
    return S.latest(spark, folder).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("s6_record_stream", f"WITH {PAIRS_SQL} SELECT trace_id, fit_level, len(skills) AS n_skills FROM p")
def record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.write_records(pairs(spark, sf_dir).select("trace_id", "fit_level", F.transform("resume.skills", lambda s: s["name"]).alias("skills")), fresh(spark), "1", "json")
    return spark.read.schema("trace_id string, fit_level string, skills array<string>").json(path).select("trace_id", "fit_level", F.size("skills").cast("long").alias("n_skills"))


@query("s7_report_csv", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark)
    S.write_report(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("segment string, n long").csv(path)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for templates: their region is the kind, every fourth is inactive."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("template_id"), F.concat(F.lit("kind_"), F.col("n_regionkey").cast("string")).alias("kind"), F.when(k % 4 == 0, False).when(k % 4 == 1, True).alias("active"), F.concat(F.lit("Write for "), "n_name").alias("text"))


@query("s8_template_ids", "SELECT n_name AS template_id FROM nation WHERE n_regionkey = 1 AND n_nationkey % 4 <> 0")
def template_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.template_ids(registry(spark, sf_dir), "kind_1")


@query("s8_template_text", "SELECT c_custkey AS k, 'Write for ' || n_name AS template FROM customer JOIN nation ON c_nationkey = n_nationkey")
def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("template_id"))
    return S.with_template(rows, registry(spark, sf_dir)).select("k", "template")


RUBRIC = "Evaluate this resume-job pair. Return ONLY one JSON object."


@query("p25_judge_prompts", f"{LABELS_SQL} SELECT trace_id, computed_fit_label AS label, skills_overlap AS overlap, {' || '.join(f'({f}::INT)' for f in policy.FLAGS)} AS flags, array_to_string(required, '|') AS required, seniority AS level, array_to_string(skills, '|') AS skills, summary FROM labels_ JOIN p USING (trace_id)")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prompts tell, read back from their three JSON parts; one that doesn't begin with the rubric tells nothing.

    A filter by the prompt would be pushed below the label projections, and each use of a text would make it anew there.
    """
    rows = metrics(pairs(spark, sf_dir), AS_OF).select("trace_id", F.split(J.judge_prompt(RUBRIC), "\n\n(?:What the rules found|Job|Candidate):\n").alias("part"))
    part = lambda k, schema: F.from_json(F.when(F.get("part", 0) == RUBRIC, F.get("part", k)), schema)
    read = rows.select(
        "trace_id", part(1, f"computed_fit_label string, skills_overlap double, {', '.join(f'{f} boolean' for f in policy.FLAGS)}").alias("r"),
        part(2, "requirements struct<required_skills: array<string>, experience_level: string>").alias("j"), part(3, "skills array<struct<name: string>>, summary string").alias("c"),
    )
    return read.select(
        "trace_id", F.col("r.computed_fit_label").alias("label"), F.col("r.skills_overlap").alias("overlap"), F.concat(*(F.when(F.col(f"r.{f}"), "1").otherwise("0") for f in policy.FLAGS)).alias("flags"),
        F.array_join("j.requirements.required_skills", "|").alias("required"), F.col("j.requirements.experience_level").alias("level"), F.coalesce(F.array_join(F.transform("c.skills", lambda s: s["name"]), "|"), F.lit("")).alias("skills"), F.col("c.summary").alias("summary"),
    )


def stand_in_judge(prompt: str) -> str:
    """Answers by the prompt's number: some calls fail, some answers aren't verdicts."""
    number = int(prompt.rsplit("-", 1)[1])
    if number % 7 == 0:
        raise TimeoutError("no answer")
    if number % 7 == 1:
        return "I can't say."
    score = 2.0 if number % 7 == 2 else 0.5
    return "```json\n" + json.dumps({"has_hallucinations": number % 2 == 0, "hallucination_details": "", "has_awkward_language": False, "awkward_language_details": "", "overall_quality_score": score, "fit_assessment": "ok", "recommendations": ["Check."], "red_flags": []}) + "\n```"


@query("u1_judge_calls", "SELECT 'pair-' || o_orderkey AS trace_id, CASE WHEN o_orderkey % 7 > 2 THEN o_orderkey % 2 = 0 END AS has_hallucinations, CASE WHEN o_orderkey % 7 > 2 THEN 0.5::DOUBLE END AS overall_quality_score, CASE o_orderkey % 7 WHEN 0 THEN 'no answer' WHEN 1 THEN 'no JSON object in the answer' WHEN 2 THEN 'the answer is not a verdict' END AS judge_error FROM orders")
def judge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = table(spark, sf_dir, "orders").select(F.concat(F.lit("pair-"), F.col("o_orderkey").cast("string")).alias("trace_id")).withColumn("prompt", F.col("trace_id"))
    answers = S.settled(J.ask_each(prompts, J.with_retries(stand_in_judge, most=2, first_delay=0.0)))
    return J.verdicts(answers).select("trace_id", "has_hallucinations", "overall_quality_score", "judge_error")


@query("u1_answers_by_prompt", "SELECT o_orderpriority || '/' || o_orderstatus AS prompt, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS n_answers, max(CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE upper(o_orderpriority) END) AS said FROM orders GROUP BY 1")
def answers_by_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a few prompts: each different one is asked once, half of them in a first run."""

    def call(prompt: str) -> str:
        priority, status = prompt.rsplit("/", 1)
        if status == "P":
            raise ValueError("pending")
        return priority.upper()

    store = fresh(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("trace_id"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("prompt"))
    J.ask_once(rows.where(F.col("prompt").startswith("1")), call, store, parallel=4)
    told = J.ask_once(rows, call, store, parallel=4)
    return rows.join(told, "trace_id").groupBy("prompt").agg(F.count("*").alias("n"), F.count("answer").alias("n_answers"), F.max(F.coalesce("answer", "error")).alias("said"))


FIXED_JOB = json.dumps(JOB)


def stand_in_fixer(prompt: str) -> str:
    """Repairs records of even length of prompt at once and others on the second try only."""
    if "Attempt 2" in prompt or "missing" in prompt:
        return f"Here it is: {FIXED_JOB}"
    return "[]" if "boss" in prompt else '{"company": "Northstar"}'


@query("u2_correction_rounds", f"{EXPECTED_SQL} SELECT k AS record, CASE WHEN k IN (SELECT k FROM errors WHERE type = 'missing') THEN 1 ELSE 2 END AS attempts, true AS succeeded FROM lines WHERE record_type = 'jobs' AND k IN (SELECT k FROM errors)")
def correction_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_lines(spark, sf_dir).where("record_type = 'jobs'")
    invalid = S.settled(V.split(V.validate(lines))[1].select(F.col("k").alias("record"), "record_type", F.col("value").alias("raw_record"), "errors"))

    def ask(prompts: DataFrame) -> DataFrame:
        answers = J.ask_each(prompts, stand_in_fixer, key="record")
        return answers.select(F.col("record").cast("long").alias("record"), F.coalesce(V.text(F.try_parse_json("answer")), J.json_object(F.col("answer")), "answer").alias("answer"))

    def validate(rows: DataFrame) -> DataFrame:
        return V.validate(rows.withColumnRenamed("raw_record", "value"))

    return C.outcomes(C.correction_rounds(invalid, ask, validate, fresh(spark))).select("record", F.col("attempts").cast("int").alias("attempts"), "succeeded")


@query("t1_review_stream", f"{EXPECTED_SQL} SELECT count(*) FILTER (k NOT IN (SELECT k FROM errors)) AS n_valid, count(*) FILTER (k IN (SELECT k FROM errors)) AS n_invalid FROM lines WHERE record_type = 'pairs'")
def review_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark)
    raw_lines(spark, sf_dir).where("record_type = 'pairs'").select("value").write.text(f"{folder}/in")
    T.review_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", AS_OF)
    good, bad = (spark.read.parquet(f"{folder}/out/{x}") for x in ("adjudications", "invalid"))
    return good.agg(F.count("*").alias("n_valid")).crossJoin(bad.agg(F.count("*").alias("n_invalid")))  # one row each


@query("t2_running_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark)
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{folder}/in")
    counts = T.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), "ts", "event_type")
    counts.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    # each batch holds the windows that it changed
    last = last_per(spark.read.parquet(f"{folder}/out"), ["window_start", "key"], ["batch"]).drop("batch")
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


RESCORED_SQL = f"""{LABELS_SQL},
dated AS (SELECT l.*, o_orderdate::TIMESTAMP AS day, o_orderkey AS k FROM labels_ l JOIN orders ON trace_id = 'pair-' || o_orderkey),
last_score AS (SELECT CASE WHEN k % 3 = 0 THEN day + INTERVAL 10 DAY ELSE day END AS day, CASE WHEN k % 3 = 0 THEN coalesce(generated_fit_label, 'unlabeled') ELSE computed_fit_label END AS computed_fit_label,
  {', '.join(f"(CASE WHEN k % 3 = 0 AND '{f}' = 'missing_core_skills' THEN NOT {f} ELSE {f} END)::INT::DOUBLE AS {f}" for f in policy.FLAGS)} FROM dated)
SELECT time_bucket(INTERVAL 30 DAY, day, TIMESTAMP '1970-01-01') AS window_start, computed_fit_label, count(*) AS n, {', '.join(f'avg({f}) AS {f}_rate' for f in policy.FLAGS)} FROM last_score GROUP BY 1, 2"""


@query("t2_rescored_rates", RESCORED_SQL)
def rescored_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third pair is scored again ten days later, every seventh score comes twice, and scores arrive in any order."""
    folder, k = fresh(spark), F.substring_index("trace_id", "-", -1).cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("analysis_date"))
    first = label_rows(spark, sf_dir).withColumn("k", k).join(orders, "k")
    again = F.struct((F.col("analysis_date") + F.expr("INTERVAL 10 DAYS")).alias("analysis_date"), F.coalesce("generated_fit_label", F.lit("unlabeled")).alias("computed_fit_label"), *((~F.col(f) if f == "missing_core_skills" else F.col(f)).alias(f) for f in policy.FLAGS))
    once = F.struct("analysis_date", "computed_fit_label", *policy.FLAGS)
    every = F.concat(F.array(once), F.when(k % 3 == 0, F.array(again)).otherwise(F.array()), F.when(k % 7 == 0, F.array(once)).otherwise(F.array()))
    first.select("trace_id", F.explode(every).alias("s")).select("trace_id", "s.*").repartition(8, F.rand(1)).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(f"trace_id string, {RS.SCORE}").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    RS.follow(spark, stream, f"{folder}/out", f"{folder}/state", late="3650 days", keep_days=3650)
    return RS.rates(spark.read.parquet(f"{folder}/out").drop("batch")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def last_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The last batch's totals."""
    rows = spark.read.parquet(folder)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).collect()[0][0]).drop("batch")
