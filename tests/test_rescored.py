"""Windowed failure rates of last scores: a stream with repeats, re-scored pairs and late rows against the batch."""

import collections
import datetime
import json
import random

from pairwright.functions import policy
from pairwright.streaming import rescored as R

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = f"trace_id string, {R.SCORE}"


def score(g, i, day):
    return (f"p{i}", DAY + datetime.timedelta(days=day, seconds=g.randint(0, 9)), g.choice(["good", "poor", None]), *(g.random() < 0.4 for _ in policy.FLAGS))


def run(spark, batches, tmp, **options):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp}/in/b{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp}/in")
        R.follow(spark, stream, f"{tmp}/out", f"{tmp}/state", width="10 days", **options)
    return sorted(map(repr, (tuple(r) for r in R.rates(spark.read.parquet(f"{tmp}/out").drop("batch")).collect())))


def test_stream_is_batch(spark, tmp_path):
    g = random.Random(4)
    rows = [score(g, i, g.randint(0, 60)) for i in range(40) for _ in range(g.randint(1, 4))]
    rows += rows[:25] + [("p1", None, "good", True, True, True, True, True)]  # repeats, and a row without a date
    ties = [("t", DAY, None, False, None, True, True, True), ("t", DAY, "good", False, False, False, False, False), ("t", DAY, "good", True, False, False, False, None)]
    g.shuffle(rows)  # so many come behind later scores of their pair
    got = run(spark, [rows[:60] + ties[:1], rows[60:100] + ties[1:], rows[100:]], tmp_path, late="400 days", keep_days=900)
    want = R.batch_rates(spark.createDataFrame(rows + ties, SCHEMA), "10 days").collect()
    assert got == sorted(map(repr, (tuple(r) for r in want)))
    assert sum(r.n for r in want) == 41


def test_late_rows_and_the_end_of_state(spark, tmp_path):
    flags = [True] * len(policy.FLAGS)
    at = lambda day: DAY + datetime.timedelta(days=day)
    batches = [
        [("a", at(0), "good", *flags), ("b", at(0), "good", *flags)],
        [("c", at(100), "good", *flags)],  # ends the state of both, which is 30 days long
        [("a", at(101), "good", *flags), ("late", at(1), "good", *flags)],  # counts anew; is dropped
        [("a", at(99), "poor", *flags)],  # older than what is known: no change
    ]
    assert len(run(spark, batches, tmp_path, late="5 days", keep_days=30)) == 2
    rows = R.rates(spark.read.parquet(f"{tmp_path}/out").drop("batch")).collect()
    assert {(r.computed_fit_label, r.n) for r in rows} == {("good", 2)}


def test_pairs_of_a_bucket_share_one_value(spark, tmp_path, monkeypatch):
    """A value of state for each pair costs milliseconds of calls a pair."""
    monkeypatch.setattr(R, "BUCKETS", 3, raising=False)
    g = random.Random(5)
    rows = [score(g, i, g.randint(0, 60)) for i in range(120) for _ in range(g.randint(1, 3))]
    rows += [(None, DAY, "good", True, False, None, True, True), ("null", DAY, None, True, True, True, True, True), ('"\\\n', DAY, "é\ud7ff\U0001f600", None, None, None, None, None)]
    g.shuffle(rows)
    got = run(spark, [rows[:100], rows[100:]], tmp_path, late="400 days", keep_days=900)
    assert got == sorted(map(repr, (tuple(r) for r in R.batch_rates(spark.createDataFrame(rows, SCHEMA), "10 days").collect())))
    kept = spark.read.format("statestore").option("stateVarName", "scores").load(f"{tmp_path}/state").collect()
    assert len(kept) <= 3 and sum(len(json.loads(r.value.pairs)) for r in kept) == 123


def test_pairs_of_a_bucket_end_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 1, raising=False)
    flags = [False] * len(policy.FLAGS)
    at = lambda day: DAY + datetime.timedelta(days=day)
    batches = [
        [("a", at(0), "good", *flags), ("b", at(20), "good", *flags), ("c", at(40), "good", *flags)],
        [("d", at(45), "good", *flags)],  # ends a alone
        [("a", at(46), "poor", *flags), ("b", at(46), "poor", *flags)],  # a counts anew, b moves
        [("d", at(60), "good", *flags)],  # would end b's first score
        [("b", at(61), "partial", *flags)],  # moves again
        [("e", at(200), "good", *flags)],  # ends all others
    ]
    run(spark, batches, tmp_path, late="5 days", keep_days=30)
    rows = R.rates(spark.read.parquet(f"{tmp_path}/out").drop("batch")).collect()
    n = collections.Counter()
    for r in rows:
        n[r.computed_fit_label] += r.n
    assert n == {"good": 4, "poor": 1, "partial": 1}
    kept = spark.read.format("statestore").option("stateVarName", "scores").load(f"{tmp_path}/state").collect()
    assert [[x[0] for x in json.loads(r.value.pairs)] for r in kept] == [["e"]]


def test_nothing(spark):
    assert R.batch_rates(spark.createDataFrame([], SCHEMA)).count() == 0
