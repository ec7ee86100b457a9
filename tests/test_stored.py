"""Tables stored by trace id: the queue's joins move nothing, and the rows are the same."""

import re

from pairwright.operators import reports, review
from pairwright.sources.stored import stored_by

LABELS = "seq long, trace_id string, requires_human_review boolean, review_reason_codes array<string>, computed_fit_label string"
VERDICTS = "seq long, trace_id string, overall_quality_score double, recommendations array<string>, red_flags array<string>, judge_error string"


def inputs(spark):
    labels = [(i, f"t{i % 40}", i % 3 == 0, ["x"] if i % 3 == 0 else [], "good") for i in range(60)] + [(99, None, True, ["x"], "poor")]
    adjudications = [(i, f"t{i}", f"label{i}") for i in range(30)]
    verdicts = [(i, f"t{i % 50}", i / 100, ["add dates. now"] if i % 2 else [], None, None if i % 5 else "failed") for i in range(70)]
    return spark.createDataFrame(labels, LABELS), spark.createDataFrame(adjudications, "seq long, trace_id string, adjudicated_fit_label string"), spark.createDataFrame(verdicts, VERDICTS)


def test_queue_of_stored_tables(spark):
    plain = inputs(spark)
    want = sorted(map(repr, review.review_queue(*plain).collect()))
    kept = [stored_by(df, buckets=3) for df in plain]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        queue = review.review_queue(*kept)
        plan = queue._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, queue.collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not re.search(r"Exchange", plan) and len(re.findall(r"SortMergeJoin", plan)) == 5 and "Bucketed: true" in plan


def test_one_file_a_bucket(spark):
    rows = spark.range(1000).selectExpr("id AS trace_id", "id % 7 AS x")
    table = stored_by(rows, buckets=4)
    assert len(table.inputFiles()) == 4 and sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))


def test_last_per_keeps_the_key(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", None, "y"), (None, 5, "z"), (None, 4, "w")], "k string, seq int, v string")
    got = sorted(map(repr, (tuple(r) for r in reports.last_per(rows, ["k"], ["seq"]).collect())))
    assert got == sorted(map(repr, [("a", 2, "x"), ("b", None, "y"), (None, 5, "z")]))
