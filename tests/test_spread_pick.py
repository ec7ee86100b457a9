"""The policy's final set against brute force, and its query's conditions."""

import itertools
import random

from pairwright.functions import policy
from pairwright.operators import spread_pick as S
from pairwright.plans import catalog

LEVELS = ("a", "b", "c")


def feasible(rooms, quota, each):
    """Whether all these jobs can send ``each`` units, by trying every share of every job."""

    def go(k, left):
        if k == len(rooms):
            return True
        return any(sum(x) == each and go(k + 1, [a - b for a, b in zip(left, x, strict=True)]) for x in itertools.product(*(range(min(r, q) + 1) for r, q in zip(rooms[k], left, strict=True))))

    return go(0, quota)


def test_as_many_jobs_as_brute_force():
    g = random.Random(11)
    for _ in range(150):
        rooms = [[g.choice((0, 0, 1, 2, 3)) for _ in LEVELS] for _ in range(g.randint(0, 6))]
        quota, each = [g.randint(0, 4) for _ in LEVELS], g.randint(1, 3)
        got = S.full_jobs(rooms, quota, each)
        assert feasible([rooms[j] for j in got], quota, each)
        want = max(len(s) for n in range(len(rooms) + 1) for s in itertools.combinations(range(len(rooms)), n) if feasible([rooms[j] for j in s], quota, each))
        assert len(got) == want, (rooms, quota, each)


def picked(spark, rows, per_level, each):
    frame = spark.createDataFrame(rows, "trace_id string, job_id string, fit_level string").selectExpr("*", "1 AS g", "2 AS take")
    return S.spread_pick(frame, "job_id", per_level, each), frame


def test_both_conditions(spark):
    # a hot job with a third of all rows, jobs of one level only, jobs that are too small, rows without level or job
    rows = [(f"h{i}", "hot", LEVELS[i % 3]) for i in range(300)] + [(f"o{j}-{i}", f"one{j}", LEVELS[j % 3]) for j in range(20) for i in range(8)]
    rows += [(f"m{j}-{i}", f"mix{j}", LEVELS[(i + j) % 3]) for j in range(30) for i in range(6)] + [(f"s{j}", f"small{j}", "a") for j in range(50)] + [("x", None, "a"), ("y", "hot", None), ("z", "hot", "other")]
    out, frame = picked(spark, rows, dict.fromkeys(LEVELS, 20), 3)
    assert out.columns == [*frame.columns, "pick"]
    got = out.collect()
    assert len(got) == len({r.trace_id for r in got}) == 60 and all(sum(r.fit_level == x for r in got) == 20 for x in LEVELS)
    jobs = {j: sum(r.job_id == j for r in got) for j in {r.job_id for r in got}}
    assert len(jobs) == 20 and set(jobs.values()) == {3}
    assert sorted(map(repr, out.collect())) == sorted(map(repr, picked(spark, rows[::-1], dict.fromkeys(LEVELS, 20), 3)[0].collect()))
    report = S.spread_report(out, "job_id", dict.fromkeys(LEVELS, 20), 20, 3).collect()[0]
    assert report.asDict() == {"n": 60, "n_jobs": 20, "least_per_job": 3, "least_per_level": 20, "short_of_levels": 0, "short_of_jobs": 0, "passed": True}


def test_shortfall(spark):
    rows = [(f"{j}-{i}", f"j{j}", "ab"[i % 2]) for j in range(3) for i in range(6)] + [("c1", "j0", "c")]
    out, _ = picked(spark, rows, dict.fromkeys(LEVELS, 4), 2)
    report = S.spread_report(out, "job_id", dict.fromkeys(LEVELS, 4), 6, 2).collect()[0]
    assert (report.n, report.n_jobs, report.short_of_levels, report.short_of_jobs, report.passed) == (9, 3, 3, 3, False)
    none, _ = picked(spark, [("a", None, "a")], {"a": 3}, 1)
    assert none.count() == 0 and S.spread_report(none, "job_id", {"a": 3}, 1, 1).collect()[0].asDict() == {"n": 0, "n_jobs": 0, "least_per_job": None, "least_per_level": 0, "short_of_levels": 3, "short_of_jobs": 1, "passed": False}


def test_query(spark, sf):
    got = catalog.QUERIES["y2_spread_pick"](spark, sf).collect()
    jobs = {j: sum(r.job_id == j for r in got) for j in {r.job_id for r in got}}
    assert len(got) == 250 and len(jobs) == 50 and set(jobs.values()) == {5} and all(sum(r.fit_level == x for r in got) == 50 for x in policy.FIT_LEVELS)
