"""Percentile sketches: merged over runs, and made exact."""

import math
import random

from pyspark.sql import functions as F

from pairwright.operators import reports as R
from pairwright.operators import sketches as K


def plain(values, share):
    values, r = sorted(values), share * (len(values) - 1)
    return values[math.floor(r)] + (values[math.ceil(r)] - values[math.floor(r)]) * (r - math.floor(r))


def frame(spark):
    g = random.Random(9)
    values = {"hot": [g.expovariate(1) for _ in range(40_000)], "equal": [2.5] * 3000, "two": [1.0, 4.0], "one": [-7.0], "steps": [float(g.randint(0, 3)) for _ in range(2000)]}
    rows = [(m, v, g.randint(1, 5)) for m, vs in values.items() for v in vs]
    return values, spark.createDataFrame(rows + [("one", None, 1), ("one", float("nan"), 1), ("none", None, 2)], "mode string, seconds double, run int")


def test_merged_runs(spark):
    values, rows = frame(spark)
    kept = K.sketched(rows, ["run", "mode"], "seconds", 400)
    got = {r["mode"]: r for r in R.latency_of_sketches(kept, {"hot": 3.0}, 400).collect()}
    assert set(got) == set(values)
    for m, vs in values.items():
        r, n = got[m], len(vs)
        assert r.n == n and r.max_s == max(vs) and abs(r.mean_s - sum(vs) / n) < 1e-9 and r.rank_error == K.rank_error(400) < 0.01
        for share, x in ((0.5, r.p50_s), (0.95, r.p95_s)):
            low, high = sum(v < x for v in vs) / n, sum(v <= x for v in vs) / n
            assert low - 2 * r.rank_error - 1 / n <= share <= high + 2 * r.rank_error + 1 / n
        assert r.passed == (r.p95_s <= r.target_s) and r.target_s == (3.0 if m == "hot" else 10.0)


def test_exact_whatever_the_sketch_says(spark):
    values, rows = frame(spark)
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    plain_rows = rows.where("seconds is not null and not isnan(seconds)").select(F.col("mode").alias("k"), F.col("seconds").alias("v"))
    for error in (K.rank_error(64), 1e-7, 0.3):  # 1e-7: no rank lies between such bounds, so they are widened
        got = {r.k: r for r in K.exact_at(plain_rows, K.sketched(plain_rows, ["k"], "v", 64), shares, error, bins=16).collect()}
        assert set(got) == set(values)
        for m, vs in values.items():
            assert got[m].n == len(vs) and all(abs(x - plain(vs, p)) < 1e-12 for p, x in zip(shares, got[m].p, strict=True))


def test_summary(spark):
    values, rows = frame(spark)
    for exact in (True, False):
        got = {r["mode"]: r for r in R.latency_summary(rows, {"hot": 2.0}, exact).collect()}
        assert set(got) == set(values) and got["equal"].p50_s == got["equal"].p95_s == 2.5
    assert abs({r["mode"]: r for r in R.latency_summary(rows, {}).collect()}["hot"].p95_s - plain(values["hot"], 0.95)) < 1e-12
    assert R.latency_summary(rows.where("mode = 'none'"), {}).count() == 0 and R.latency_summary(rows.limit(0), {}).count() == 0
