"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from pairwright.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_shifts_and_runs():
    g = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 127, 1000, 70_001):
        a, b = g.bytes(9), g.bytes(n)
        got = R.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)
    words = [b"a", b"bc", b"x" * 500, "é".encode(), b"a", b"bc"]
    payloads = np.array([len(w) << 32 | zlib.crc32(w) for w in words])
    found = R.run_checksums(payloads, np.array([0, 0, 0, 0, 1, 1]), 3)
    assert [int(c) for (crc, of) in found for c, o in zip(crc, of, strict=True) if o == 0] == [zlib.crc32(b" ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(4 - k + 1)]
    assert [len(of[of == 1]) for _, of in found] == [2, 1, 0]


def test_scan_emits_every_word():
    text = b"ab  abc ab\tb abc  a ".translate(R.PLAIN)
    known = R.dictionary(set(text.split()))
    assert [int(p) & 0xFFFFFFFF for p in R.emitted(known, text)] == [zlib.crc32(w) for w in text.split()]
    assert len(R.emitted(R.dictionary([]), b"  ")) == 0


def brute(docs, target, buckets, percent, least, seed):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(buckets)}
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


def test_rows(llm_spark):
    g = random.Random(5)
    word = lambda: "".join(g.choices(["An", "be", "é", "9", "Ω", "zu"], k=g.randint(1, 4)))
    docs = [(i, g.choice([" ", "  ", ",\n", "-"]).join(word() for _ in range(g.randint(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .\t"), (None, docs[3][1]), (None, None), (7, docs[7][1]), (203, "y" * 100_000), (204, "Ab " * 40_000), (205, "one"), (7, "a different text of the same id")]
    target = [" ".join(word() for _ in range(40)) for _ in range(5)] + [None, ""]
    frame = llm_spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS score", "'x' AS features", "1 AS `before`").repartition(3)
    aims = llm_spark.createDataFrame([(t,) for t in target], "text string")
    for buckets in (97, 100_000):
        scored = R.importance_scores(frame, aims, buckets=buckets)
        assert scored.columns == ["doc_id", "text", "features", "before", "n_features", "weight", "score"]
        got = R.drawn(scored.drop("text")).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(docs, target, buckets, 25, 20, 7)
    kept = R.resampled(frame, aims, percent=50, least_words=5, buckets=97)
    want = [r for r in brute(docs, target, 97, 50, 5, 7) if not r.endswith("None)")]
    assert sorted(repr(tuple(r)) for r in kept.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want


def test_nothing(llm_spark):
    frame = llm_spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert R.resampled(frame.limit(0), frame).count() == 0
    assert R.importance_scores(frame, frame.limit(0)).count() == 1
    assert [r["rank"] for r in R.drawn(R.importance_scores(frame, frame)).collect()] == [None]


def test_groups_of_texts_do_not_matter(llm_spark):
    rows = pd.DataFrame({"text": [f"word{i} word{i + 1} WORD{i}" for i in range(50)]})
    frame = llm_spark.createDataFrame(rows)
    a, b = (sorted(bytes(r[0]) for r in R.featured(frame, "f", 1000, 2, size).select("f").collect()) for size in (1, 1 << 20))
    assert a == b
