import itertools
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from pairwright.llm.mixing import mix, route, targets_of


def test_targets():
    t = targets_of({"b": 10, "a": 1000, None: 500, "c": 40})
    assert t == {"a": 1225, "b": 20, "c": 80, None: 1000} and sum(t.values()) == Fraction(3, 2) * 1550
    assert targets_of({}) == {} and targets_of({"a": 0}) == {"a": 0}


def cost_of(flow, capacity):
    return sum(max(0, sum(f) - c) for f, c in zip(flow, capacity, strict=True))


def test_route_is_optimal():
    g = random.Random(5)
    for _ in range(40):
        cap = [g.randint(0, 3) for _ in range(3)]
        members = [sorted(g.sample(range(2), g.randint(1, 2))) for _ in cap]
        quota = [g.randint(0, 5) for _ in range(2)]
        flow = route(cap, members, quota)
        sent = [sum(f[i] for f, m in zip(flow, members, strict=True) for i, s in enumerate(m) if s == k) for k in range(2)]
        assert all(s <= q for s, q in zip(sent, quota, strict=True)) and all(sum(f) <= 2 * c for f, c in zip(flow, cap, strict=True))
        best = None
        for guess in itertools.product(*(range(2 * c + 1) for c, m in zip(cap, members, strict=True) for _ in m)):
            it = iter(guess)
            other = [[next(it) for _ in m] for m in members]
            out = [sum(f[i] for f, m in zip(other, members, strict=True) for i, s in enumerate(m) if s == k) for k in range(2)]
            if all(sum(f) <= 2 * c for f, c in zip(other, cap, strict=True)) and all(o <= q for o, q in zip(out, quota, strict=True)):
                key = (-sum(out), cost_of(other, cap))
                best = key if best is None or key < best else best
        assert (-sum(sent), cost_of(flow, cap)) == best


def test_mix(llm_spark):
    g = random.Random(7)
    rows = [(i, " ".join(["w"] * g.randint(0, 30)) + " \x0b", g.choice(["a", "b", "é", None]), 9) for i in range(400)] + [(900, None, "a", 9), (901, "", "empty", 9), (901, "", "empty", 9)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and (r.size == 0 or r.taken % r.size == 0) and r.taken <= 2 * r.size
        s = sums.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
    want = targets_of({k: v[0] for k, v in sums.items()})
    for k, (size, taken, target, told) in sums.items():
        assert told == size and abs(target - float(want[k])) < 1e-6 and abs(taken - target) <= 31
    again = {(r.doc_id, r.taken) for r in mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mix(docs.limit(0)).count() == 0
    over = mix(docs.withColumn("of", F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("z"))).when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))), "of").collect()
    assert len(over) == len(rows) and all(r.taken == 0 for r in over if r.of == [])


def test_copies_meet_the_target(llm_spark):
    rows = [(1, "w " * 10, "a")] * 2000 + [(k, "v " * 7, "a") for k in range(2, 300)] + [(None, "u " * 10, "b")] * 3000 + [(5, "t " * 10, None)] * 10
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS __p", "1 AS __h").repartition(5)
    got = mix(docs).collect()
    assert len(got) == len(rows) and all(r["__p"] == "x" and r["__h"] == 1 for r in got)
    for source in ("a", "b", None):
        of = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 5 and all(r.taken % r.size == 0 and r.taken <= 2 * r.size for r in of)
    assert sorted((str(r.doc_id), r.taken) for r in mix(docs).collect()) == sorted((str(r.doc_id), r.taken) for r in got)
