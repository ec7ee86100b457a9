"""Rules on small rows of their own."""

import collections
import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pairwright.functions.skills import analysis_skill, jaccard, plain_skill
from pairwright.functions.text import count_terms, json_object, repeated_nearby, repeated_windows, tokens
from pairwright.operators import judge, labels, policy_splits, reports, review, synthesis, validate
from pairwright.plans.io_plans import judge_prompts
from pairwright.plans.validation_plans import CASES
from pairwright.sources import records
from pairwright.streaming.review import review as review_batch
from pairwright.streaming.review import review_stream, windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [(" Python 3.11 Developer ", "python"), ("Node.js", "node"), ("C++", "c++"), ("c#", "c"), ("Tech12", "tech"), ("Engineer", ""), ("Front-End  Engineer", "front end")])
def test_analysis_skill(spark, raw, want):
    assert one(spark, analysis_skill(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("Python 3.11", "python"), ("Web Developer", "web"), ("Node.js", "node"), ("Data Engineer Developer", "data engineer"), ("C#", "c#")])
def test_plain_skill(spark, raw, want):
    assert one(spark, plain_skill(F.lit(raw))) == want


def test_jaccard(spark):
    arr = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    assert [one(spark, jaccard(a, b)) for a, b in ((arr(), arr()), (arr("a"), arr()), (arr("a", "b"), arr("b", "c")))] == [1.0, 0.0, 1 / 3]


def test_text(spark):
    assert one(spark, count_terms(F.lit("Synergy synergy leverage, leveraging"))) == 4
    run = "one two three four five six seven eight nine ten "
    assert [one(spark, repeated_windows(tokens(F.lit(t)))) for t in (run * 3, run * 2, "a " * 12, "a " * 11, "")] == [True, False, True, False, False]
    assert [one(spark, repeated_nearby(tokens(F.lit(t)))) for t in ("clarity clarity clarity in all that we do", "clarity clarity clarity", "the the the in all that we do", "")] == [True, False, False, False]
    assert one(spark, json_object(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(spark, json_object(F.lit("} none {"))) is None


@pytest.mark.parametrize("overlap, missing, want", [(0.8, False, "excellent"), (0.9, True, "good"), (0.795, False, "good"), (0.4, False, "partial"), (0.3999, False, "poor"), (0.0, False, "complete_mismatch")])
def test_fit(spark, overlap, missing, want):
    assert one(spark, labels.fit_of(F.lit(overlap), F.lit(missing))) == want


def test_repeats_are_brute_force(spark):
    g = random.Random(6)
    texts = [[g.choice(["a", "bbb", "core", "wider"][: g.randint(1, 4)]) for _ in range(n)] for n in [*range(30), *range(30)]]
    run = [f"w{k}" for k in range(10)]
    texts += [run * 3, run * 2 + run[:9], [*run, "x", *run, "y", *run], [*run, "x", *run, "y", *run[1:]], [x for y in run for x in (y, y, y)], [*run, *run, *run[::-1], *run[::-1]]]
    want = [(max(collections.Counter(tuple(t[i : i + 10]) for i in range(len(t) - 9)).values(), default=0) >= 3, len(t) >= 8 and any(len(x) >= 4 and t[i : i + 8].count(x) >= 3 for i, x in enumerate(t))) for t in texts]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, words array<string>")
    got = rows.select("k", repeated_windows(F.col("words")).alias("w"), repeated_nearby(F.col("words")).alias("n")).orderBy("k").collect()
    assert [(r.w, r.n) for r in got] == want and {w for w, _ in want} == {n for _, n in want} == {True, False}


def test_a_prompt_is_made_once(spark, sf):
    """A filter by the prompt would go below the labels and make prompt and texts anew for each place that uses them."""
    plan = judge_prompts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator(") == 3


def test_titles(spark):
    rows = spark.createDataFrame([([("Director of Sales",)],), ([("Team Lead",)],), ([("Senior Cook",)],), ([],)], "e array<struct<position:string>>")
    assert [r.x for r in rows.select(labels.resume_seniority(F.col("e"), F.lit(2.0)).alias("x")).collect()] == ["executive", "lead", "senior", "mid_level"]  # "director" holds "cto"


def test_errors_of_every_case(spark):
    rows = spark.createDataFrame([(i, t, v.replace("@K@", str(i))) for i, (t, v, _) in enumerate(CASES)], "i int, record_type string, value string")
    got = {r.i: [(e.loc, e.type, e.category) for e in r.errors] for r in validate.validate(rows).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(CASES)}


def test_category_words(spark):
    rows = spark.createDataFrame([("x", "value_error", "Bad format", "contact.email"), ("x", "value_error", "Bad format", "name"), ("x", "less_than", "", "a"), ("x", "enum", "", "a"), ("x", "date_parsing", "", "a")], "k string, type string, msg string, loc string")
    assert [r.c for r in rows.select(validate.category(F.struct("type", "msg", "loc")).alias("c")).collect()] == ["format_violations", "type_mismatches", "logical_inconsistencies", "enum_mapping_failures", "format_violations"]


def test_correlations_without_variance(spark):
    base = dict(skills_overlap=0.5, experience_mismatch=True, seniority_mismatch=False, missing_core_skills=True, hallucinated_skills=False, awkward_language=False)
    for n in (0, 1, 3):
        rows = spark.createDataFrame([tuple(base.values())] * n, "skills_overlap double, " + ", ".join(f"{f} boolean" for f in list(base)[1:]))
        assert [r.r for r in reports.correlations(rows).collect()] == [0.0] * 36


def test_latency(spark):
    rows = spark.createDataFrame([("rules_only", x) for x in (0.5, 0.8, 0.9, 1.1)] + [("with_judge", x) for x in (9.5, 10.5, 11.0)], "mode string, seconds double")
    got = {r.mode: (round(r.p95_s, 4), r.passed) for r in reports.latency_summary(rows, {"rules_only": 2.0, "with_judge": 10.0}).collect()}
    assert got == {"rules_only": (1.07, True), "with_judge": (10.95, False)}


def test_queue_counts_repeats(spark):
    label = spark.createDataFrame([(1, "a", True, ["x"], "good"), (2, "a", True, ["y"], "poor"), (1, "b", False, [], "good")], "seq long, trace_id string, requires_human_review boolean, review_reason_codes array<string>, computed_fit_label string")
    verdict = spark.createDataFrame([(1, "b", 0.5, ["r"], [], None), (2, "b", 0.6, ["s"], [], None), (1, "a", 0.1, ["t"], [], None), (3, "c", 0.9, [], [], None), (4, "d", None, [], [], "failed")], "seq long, trace_id string, overall_quality_score double, recommendations array<string>, red_flags array<string>, judge_error string")
    rows = review.review_queue(label, label.select("seq", "trace_id", F.col("computed_fit_label").alias("adjudicated_fit_label")), verdict).collect()
    assert sorted((r.trace_id, r.queue_reason, tuple(r.review_reason_codes), tuple(r.judge_recommendations)) for r in rows) == [("a", "human_review_flag", ("y",), ("t",)), ("b", "recommendation_only", (), ("r",)), ("b", "recommendation_only", (), ("s",))]


def test_retries():
    calls = []

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return "ok"

    assert judge.with_retries(call, most=3, sleep=lambda s: None)("p") == "ok" and len(calls) == 3
    with pytest.raises(ValueError):
        judge.with_retries(lambda p: (_ for _ in ()).throw(ValueError("no")), sleep=lambda s: None)("p")


def test_line_numbers_of_split_files(spark, tmp_path):
    lines = [("" if i % 7 == 3 else f"line {i} " + "x" * (i % 50)) for i in range(1, 5001)]
    (tmp_path / "jobs_a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "pairs_b.jsonl").write_text("line 1 \n\nline 3 ")
    (tmp_path / "notes.txt").write_text("line 1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = records.record_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(int(r.value.split()[1]) == r.line_number for r in rows)
    assert {r.record_type for r in rows} == {"jobs", "pairs"} and len(rows) == sum(map(bool, lines)) + 2
    with pytest.raises(FileNotFoundError):
        (tmp_path / "sub").mkdir()
        (tmp_path / "sub" / "notes.txt").write_text("x")
        records.record_lines(spark, str(tmp_path / "sub"))


def test_no_other_file_is_read(spark, tmp_path):
    for name, text in (("jobs_a.jsonl", "1\n\n \t\n4\n"), ("a b/pairs_[x]*.jsonl", "1\n2"), ("other.jsonl", "x\n"), ("jobs_c.txt", "x\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [p.rsplit("/", 1)[1] for p in records.record_files(spark, str(tmp_path))] == ["pairs_[x]*.jsonl", "jobs_a.jsonl"]
    got = records.record_lines(spark, str(tmp_path))
    assert sorted((r.record_type, r.line_number, r.value) for r in got.collect()) == [("jobs", 1, "1"), ("jobs", 4, "4"), ("pairs", 1, "1"), ("pairs", 2, "2")]
    assert "other.jsonl" not in str(got.inputFiles())


def test_first_invalid_line_is_named(spark):
    checked = spark.createDataFrame([("pairs", "pairs_b.jsonl", 2, "{}", 1), ("pairs", "pairs_a.jsonl", 9, "{}", 1), ("pairs", "pairs_a.jsonl", 10, "{}", 2), ("jobs", "jobs_a.jsonl", 1, "{}", 1)], "record_type string, source_file string, line_number long, value string, error_count int")
    for rows in (checked, checked.orderBy(F.desc("line_number")), checked.repartition(4)):
        with pytest.raises(ValueError, match="pairs_a.jsonl line 9$"):
            records.strict_pairs(rows)


def test_one_document(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"summary": {"n": 2},\n "records": {"jobs": [1], "pairs": [{"a": "x\\ny"},\n {"b": [1.5, null]}]}}')
    (tmp_path / "w.json").write_text('{"summary": {}, "records": {}}')
    got = records.document_records(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, r.source_file, r.line_number, json.loads(r.value)) for r in got) == [("pairs", "v.json", 1, {"a": "x\ny"}), ("pairs", "v.json", 2, {"b": [1.5, None]})]


def test_only_complete_runs_count(spark, tmp_path):
    rows = spark.range(3).withColumn("x", F.lit("a"))
    for stamp in ("20240101", "20240103", "20240102"):
        records.write_records(rows.where(F.col("id") < int(stamp[-1])), f"{tmp_path}/r", stamp, "json")
    rows.write.json(f"{tmp_path}/r/run_ts=20240109")  # no manifest: it isn't known to be whole
    assert list(records.complete_runs(spark, f"{tmp_path}/r")) == ["20240101", "20240102", "20240103"]
    last = records.latest(spark, f"{tmp_path}/r")
    assert sorted(map(tuple, last.collect())) == [(0, "a", "20240103"), (1, "a", "20240103"), (2, "a", "20240103")] and last.schema["id"].dataType.simpleString() == "bigint"
    rows.write.json(f"{tmp_path}/u/run_ts=1")
    with pytest.raises(FileNotFoundError):
        records.latest(spark, f"{tmp_path}/u")


def test_plan(spark):
    jobs = spark.range(50).withColumnRenamed("id", "job_index")
    plan = synthesis.generation_plan(jobs, 5, 0.2, 42)
    assert plan.count() == 250 and plan.where("niche_target").select("job_index").distinct().count() == 10
    assert {r["count"] for r in plan.groupBy("fit_level").count().collect()} == {50}
    with pytest.raises(ValueError):
        synthesis.generation_plan(jobs, 5, 1.2, 42)
    made = labels.label(synthesis.generated_pairs(jobs, 5), "2024-06-01")
    assert made.count() == made.select("trace_id").distinct().count() == 250


def test_groups_are_not_split(spark):
    rows = spark.range(2000).select(F.col("id").alias("trace_id"), (F.col("id") % 100).alias("job"), (F.col("id") % 4).alias("industry"))
    out = policy_splits.split_by_group(rows, "job", ["industry"])
    assert out.groupBy("job").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    shares = {r.split: r["count"] / 2000 for r in out.groupBy("split").count().collect()}
    assert shares == {"calibration": 0.6, "validation": 0.2, "holdout": 0.2}


def test_stream_is_batch(spark, tmp_path):
    lines = [v.replace("@K@", str(i)) for i, (t, v, _) in enumerate(CASES) if t == "pairs"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[::2]) + "\n\n")
    (tmp_path / "in" / "b.txt").write_text("\n".join(lines[1::2]))
    review_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", "2024-06-01")
    good, bad = review_batch(spark.createDataFrame([(x,) for x in lines], "value string"), "2024-06-01")
    key = lambda df: sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out/adjudications").drop("batch")) == key(good)
    assert spark.read.parquet(f"{tmp_path}/out/invalid").count() == bad.count() and good.count() + bad.count() == len(lines)


def test_late_rows_are_dropped(spark, tmp_path):
    def arrive(number, *times):
        spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, m), "a", 1.0) for h, m in times], "ts timestamp, kind string, value double").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(f"{tmp_path}/in")
        out = windowed_counts(stream, "ts", "kind").writeStream.outputMode("update")
        out.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}_{n}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    arrive(0, (9, 10), (12, 0))
    arrive(1, (9, 20), (12, 10), (11, 40))  # 9:20 is over half an hour behind 12:00, 11:40 is not
    rows = spark.read.parquet(f"{tmp_path}/out")
    got = {r.window_start.hour: r.n for r in reports.last_per(rows, ["window_start", "key"], ["batch"]).collect()}
    assert got == {9: 1, 11: 1, 12: 2}


def test_exact_percentiles(spark):
    g = random.Random(3)
    values = {"many": [g.gauss(0, 1) for _ in range(30_000)], "equal": [2.5] * 5000 + [3.5], "two": [1.0, 2.0], "one": [7.0], "few": [g.choice([1.0, 2.0, 9.0]) for _ in range(999)]}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("none", None)], "mode string, seconds double")
    got = {r["mode"]: r for r in reports.exact_percentiles(frame, "mode", "seconds", (0.0, 0.5, 0.95, 1.0), 1000).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        vs.sort()
        for p, x in zip((0.0, 0.5, 0.95, 1.0), got[k].p):
            r = p * (len(vs) - 1)
            low = vs[math.floor(r)]
            assert abs(x - (low + (vs[math.ceil(r)] - low) * (r - math.floor(r)))) < 1e-12 and got[k].n == len(vs)


def test_policy_pick(spark):
    rows = spark.range(3000).select(F.col("id").alias("trace_id"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 300).alias("job"))  # a hot job, and few of four rows
    picked = policy_splits.policy_pick(rows, "job", 50, 3)
    report = policy_splits.pick_report(picked, "job", 50, 3).first()
    assert (report.n, report.n_jobs, report.least_per_job, report.passed) == (150, 50, 3, True)
    assert not policy_splits.pick_report(policy_splits.policy_pick(rows, "job", 50, 5), "job").first().passed  # only the hot job has five


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="labels, judge"):
        records.missing_inputs(spark, {"labels": f"{tmp_path}/labels_*", "judge": f"{tmp_path}/judge_*", "folder": str(tmp_path)})
    with pytest.raises(FileNotFoundError):
        records.latest(spark, str(tmp_path))


@pytest.mark.parametrize("email, want", [("Jo@Example.COM", "jo@example.com"), ("jo@mail.test", None), ("jo@x.local", None), ("jo@localhost", None), ("jörg@bücher.de", "jörg@bücher.de"), ("a b@x.org", None), (".a@x.org", None), ("a@x..org", None), ("a@-x.org", None), ("a@1.2.3.4", None)])
def test_emails(spark, email, want):
    assert one(spark, validate.normal_email(F.lit(email))) == want
