"""Vector codes against plain whole-number distances."""

import hashlib
import math
import random

import numpy as np

from pairwright.llm import vector_codes as V


def test_walsh():
    for size in (1, 2, 4, 8, 16):
        w = V.walsh(size)
        assert (w @ w.T == size * np.eye(size, dtype=int)).all()
        assert [int((np.diff(r) != 0).sum()) for r in w] == list(range(size))  # in the order of sequency


def test_nearest_is_exact():
    g = np.random.default_rng(3)
    for part in (1, 3, 4, 5, 16):
        most = V.largest(part)
        for high in (3, 1000, most):
            x, c = g.integers(-high, high + 1, (500, part)), g.integers(-high, high + 1, (20, part))
            c[7], c[3] = c[5], c[11]  # equal entries: the lower index wins
            x[:20] = c
            index, distance = V.nearest(V.transformed(x), V.transformed(c), strip=64)
            want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, e, strict=True)), k) for k, e in enumerate(c)) for row in x]
            assert list(zip(distance.tolist(), index.tolist(), strict=True)) == want


def brute(rows, parts, entries, rounds):
    live = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max(len(r[1]) for r in live)
    part = max(-(-longest // parts), 1)
    whole = [[math.floor(256 * x) for x in r[1]] + [0] * (part * parts - len(r[1])) for r in live]
    cut = [[w[p * part : (p + 1) * part] for p in range(parts)] for w in whole]
    order = sorted(range(len(live)), key=lambda i: (live[i][0] is None, live[i][0] or 0, live[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(cut[i][p][d] for i in range(len(cut)) if of[i] == k) // of.count(k) for d in range(part)] if k in of else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for r, e in zip(live, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((r[0], "".join(f"{k:02x}" for _, k in f), e, total[r[2]], digest)) for r, f, e in zip(live, found, error, strict=True))


def rows_of(g, n, size):
    return [(i, [round(g.gauss(0, 1), 3) for _ in range(size)], g.choice([None, "a", "b", "c"])) for i in range(n)]


def test_rows(llm_spark):
    g = random.Random(8)
    rows = rows_of(g, 120, 12)
    rows += [(300, None, "a"), (301, [1.0, None] + [0.0] * 10, "a"), (302, [float("nan")] * 12, "b"), (303, [float("inf")] * 12, "b"), (304, [0.0] * 12, "zero"), (5, rows[5][1], rows[5][2]), (None, rows[9][1], None), (305, [1.5] * 7, "short"), (306, [], "empty")]
    frame = llm_spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "'clash' AS code", "0 AS error", "'o' AS `of`", "1 AS got").repartition(3)
    for parts, entries, most in ((4, 16, 100), (4, 256, 0), (5, 8, 100)):  # both joins; fewer rows than entries; parts that don't divide
        got = V.vector_codes(frame, parts, entries, most_broadcast=most)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, parts, entries, 2)


def test_large_numbers_and_labels_of_any_type(llm_spark):
    rows = [(1, [3e38] * 4, 0.0), (2, [-3e38] * 4, -0.0), (3, [1.0] * 4, None), (4, [1.0] * 4, float("nan"))]
    got = {r.vec_id: r for r in V.vector_codes(llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>, label double"), parts=1, entries=1, rounds=0).collect()}
    assert got[1].error == 0 and got[2].error == 4 * (2 * V.largest(4)) ** 2 and got[2].label_error == got[1].label_error == got[2].error


def test_nothing(llm_spark):
    frame = llm_spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert V.vector_codes(frame).count() == 0 and V.vector_codes(frame.limit(0)).count() == 0
