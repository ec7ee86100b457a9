"""The policy's split by industry and seniority, and its balance report."""

from pairwright.operators import policy_splits as Y
from pairwright.plans import catalog
from tests.helpers import assert_same


def test_policy_split(spark, sf):
    for name in ("y1_policy_split", "y1_fit_balance"):
        assert_same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


def test_strata_and_balance(spark):
    rows = [(f"{i}-{s}-{j}-{k}", f"{i}-{s}-{j}", i, s, (None, "good")[k % 2]) for i in "ab" for s in ("senior", "mid") for j in range(10) for k in range(4)]
    out = Y.split_by_group(spark.createDataFrame(rows, "trace_id string, job_id string, industry string, seniority string, fit_level string"), "job_id", ["industry", "seniority"])
    jobs = out.select("industry", "seniority", "split", "job_id").distinct().groupBy("industry", "seniority", "split").count().collect()
    assert len(jobs) == 12 and all(r["count"] == {"calibration": 6, "validation": 2, "holdout": 2}[r.split] for r in jobs)
    assert {(r.split, r.fit_level, r.n, r.share) for r in Y.fit_balance(out).collect()} == {(s, f, n, 0.5) for s, n in (("calibration", 48), ("validation", 16), ("holdout", 16)) for f in ("good", "unlabeled")}
