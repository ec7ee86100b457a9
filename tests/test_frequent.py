"""The most frequent texts: by sketch and exact counts, or by counting all where the sketch can't tell."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pairwright.operators.review import most_frequent, recommendation_openings


def top(texts, n):
    return sorted(Counter(texts).items(), key=lambda x: (-x[1], x[0]))[:n]


def test_most_frequent(spark):
    g = random.Random(1)
    heavy = [f"h{i}" for i in range(8) for _ in range(400 - 30 * i)]
    cases = {"clear": heavy + [f"x{i}" for i in range(5000)], "ties": [f"t{i}" for i in range(300)] * 3, "few": ["a", "b", "a"], "none": []}
    for name, texts in cases.items():
        g.shuffle(texts)
        frame = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
        for tracked, listed in ((1000, 20), (16, 8)):  # the smaller sketch can't tell, so all are counted
            assert [(r["text"], r["count"]) for r in most_frequent(frame, 5, tracked, listed).collect()] == top(texts, 5), (name, tracked)


def test_openings(spark):
    rows = [(["  Add dates. And more", "add", ""],), (["Add dates"],), (None,), ([None, "x" * 100],)]
    got = recommendation_openings(spark.createDataFrame(rows, "judge_recommendations array<string>"))
    assert [(r["text"], r["count"]) for r in got.collect()] == [("Add dates", 2), ("add", 1), ("x" * 80, 1)]
    assert got.where(F.col("count") > 9).count() == 0
