"""Calls in flight, their budget, and answers that are kept by prompt."""

import time

import pytest

from pairwright.operators import judge as J


def rows(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "trace_id long, prompt string").coalesce(1)


def test_calls_in_flight(spark):
    def slow(prompt):
        time.sleep(0.5)
        if prompt == "p3":
            raise TimeoutError("too late")
        return prompt.upper()

    rows(spark, ["warm"]).mapInPandas(lambda fs: fs, "trace_id long, prompt string").count()
    frame = rows(spark, [f"p{i}" for i in range(16)])
    began = time.time()
    got = J.ask_each(frame, slow, in_flight=16).collect()
    took = time.time() - began
    assert took < 8 * 0.5  # one after the other they take 16 times as long
    assert [(r.trace_id, r.answer, r.error) for r in got] == [(str(i), None, "too late") if i == 3 else (str(i), f"P{i}", None) for i in range(16)]


def test_budget(spark):
    frame = spark.range(40).selectExpr("id AS trace_id", "CASE WHEN id % 10 = 9 THEN NULL ELSE 'p' || id END AS prompt")
    got = J.ask_each(frame, str.upper, parallel=3, budget=10).collect()
    assert sum(r.answer is not None for r in got) == 10 and len(got) == 40
    assert sum(r.error == "no prompt" for r in got) == 4 and sum(r.error == "the call budget is spent" for r in got) == 26
    assert [J.share_of(10, k, 3) for k in range(3)] == [4, 3, 3]
    with pytest.raises(ValueError):
        J.ask_each(frame, str.upper, budget=3)


def test_no_prompt_is_asked_twice(spark, tmp_path):
    log = tmp_path / "calls"
    log.touch()

    def call(prompt):
        with log.open("a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise ValueError("no")
        return prompt[::-1]

    frame = rows(spark, ["ab", "cd", "ab", None, "bad", "ab"])
    for more in (["ab"], ["ef"]):
        got = J.ask_once(frame.union(rows(spark, more)), call, f"{tmp_path}/store", parallel=2)
        said = [(r.answer, r.error) for r in got.where("trace_id <> '0'").collect()] + [(r.answer, r.error) for r in got.where("trace_id = '0'").collect()]
        assert sorted(map(repr, said)) == sorted(map(repr, [("ba", None)] * 3 + [("dc", None), (None, "no prompt"), (None, "no"), (more[0][::-1], None)]))
    assert sorted(log.read_text().split()) == ["ab", "bad", "bad", "cd", "ef"]  # what failed is asked again
