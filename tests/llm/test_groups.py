"""Components, SimHash groups and vector groups against brute force."""

import random
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from pairwright.llm.common import local_components
from pairwright.llm.components import components
from pairwright.llm.embedding_dedup import cells, cells_of, embedding_groups, fit_cells
from pairwright.llm.simhash import blocks_for, fingerprint_of, keep_one, near_fingerprints, simhash_groups


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def test_components(llm_spark):
    g = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(g.randint(200, 260), g.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {r.node: r.component for r in components(llm_spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    want = roots(300, links)
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert components(llm_spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_fingerprints(llm_spark):
    g = np.random.default_rng(4)
    base = g.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << g.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8))]))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    want = roots(len(fps), links)
    frame = llm_spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    assert [blocks_for(n) for n in (0, 10**8, 10**9, 10**12, 10**15)] == [6, 6, 7, 8, 8]
    for rows, blocks in ((2048, None), (3, None), (2048, 7), (5, 8)):  # whole keys, keys dealt over sub-blocks, longer keys
        found = [(place[r.a], place[r.b]) for r in near_fingerprints(frame, block_rows=rows, blocks=blocks).collect()]
        # a forest names some member of a group, so its links are held against the groups, not the distance
        assert all(want[a] == want[b] for a, b in found) and roots(len(fps), found) == want


def test_simhash_groups(llm_spark):
    g = random.Random(6)
    vocabulary = [f"w{i}é" for i in range(500)]
    long = [" ".join(g.choices(vocabulary, k=400)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(long)] + [(50 + i, t.replace(" w1é ", " w2é ", 1).upper()) for i, t in enumerate(long)] + [(70, None), (71, ""), (72, "\t "), (73, "one two"), (74, "One TWO"), (75, "one two three four"), (None, long[0]), (None, None), (2, long[2]), (80, "x " * 20000)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    fps = [fingerprint_of((t or "").encode()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = roots(len(rows), links)
    want = sorted((str(rows[i][0]), f"{fps[i]:016x}", min(rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None)) for i in range(len(rows)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()) == want
    assert fingerprint_of(None) == 0 and simhash_groups(docs.limit(0)).count() == 0
    kept = keep_one(docs)  # one row of each group, also of rows equal in id and text and of rows without an id
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    alone = llm_spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, "x y z u v"), (1, "x y z u v"), (1, "x y z u v"), (None, "p q r s t"), (None, None), (None, "")], "doc_id long, text string").withColumn("__id", F.lit(5))
    assert sorted((str(r.doc_id), r.text or "") for r in keep_one(alone).collect()) == [("1", "x y z u v"), ("None", ""), ("None", "a b c d e"), ("None", "p q r s t")]
    assert keep_one(alone.limit(0)).count() == 0


def independent_fingerprint(text):
    """Bit by bit in Python's own whole numbers, over shingles cut with a regular expression of text."""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(llm_spark):
    g = random.Random(9)
    texts = [None, "", " \t", "One", "a b\x0bc", "É Über x y z É", "a b c d " * 50] + [" ".join(g.choices(["Aa", "bb", "ç", "0", "d-e", "É"], k=n)) for n in range(1, 40)]
    got = {r.doc_id: r.fingerprint for r in simhash_groups(llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: f"{independent_fingerprint(t):016x}" for i, t in enumerate(texts)}
    # the hash itself, by Spark's own function of the same name
    spark_hash = llm_spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0] % 2**64
    assert spark_hash == xxhash.xxh64(b"one two three four", seed=42).intdigest()


def test_embedding_groups(llm_spark):
    g = np.random.default_rng(8)
    near = lambda v: v + g.normal(size=8) * 0.04
    base = [g.normal(size=8) for _ in range(30)]
    vectors = [(i, [float(x) for x in np.float32(v)], int(i % 3)) for i, v in enumerate(base + [near(base[k % 30]) for k in range(90)] + [base[3]] * 5)]
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, vectors[3][1], None), (904, [], 0), (905, [1.0], 0), (905, [1.0], 0), (None, vectors[3][1], 0), (906, [None] + [1.0] * 7, 0)]
    rows = vectors + odd
    frame = llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def fits(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not fits(a[1]) or not fits(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.float64(a[1]), np.float64(b[1])
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 - 1e-12

    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(rows[i], rows[j])]
    root = roots(len(rows), links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    least = [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    want = sorted((str(rows[i][0]), int(degree[i]), str(least[i]), rows[i][0] is not None and rows[i][0] == least[i]) for i in range(len(rows)))
    for cell, block in ((2000, 1024), (8, 5)):
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_groups(frame, cell_rows=cell, block_rows=block).collect()) == want
    assert embedding_groups(frame.limit(0)).count() == 0


def test_cells_on_the_given_table(llm_spark, sf):
    """The vectors of the smallest table are compared within cells of fitted centroids."""
    rows = llm_spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").cast("string").alias("label"), "embedding", "vec_id").where("embedding is not null")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert [cells_of(n, 2000) for n in (1, 47, 48, 100, 5000, 20_000)] == [1, 1, 2, 4, 4, 10]
    # as many as the labels have, had each ten times as many vectors
    more = rows.select("label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "embedding", "vec_id").withColumn("embedding", F.transform("embedding", lambda x: x + F.col("k") * 0.01)).select("label", "embedding", F.lit(1).cast("long").alias("n"), F.xxhash64("vec_id", "k").alias("rid"))
    found = fit_cells(more, 2000, 20, 4096)
    assert {k[0]: len(c) for k, c in found.items()} == {label: cells_of(10 * n, 2000) for label, n in sizes.items() if label is not None and cells_of(10 * n, 2000) > 1} and found
    placed = cells(more, found, 0.98)
    assert placed.where("host").select("label", "cell").distinct().count() > len(found)


def test_labels_and_sizes_of_any_kind(llm_spark):
    rows = [(1, [1e-200, 2e-200], "x"), (2, [1e300, 2e300], "x"), (3, [1.0, 2.0], "y"), (4, [float("inf"), 1.0], "x"), (5, [-1e-200, -2e-200], "x"), (6, [3.0, 6.0], None)]
    for kind, label in (("string", lambda x: x), ("double", lambda x: {"x": 0.0, "y": 1e10}.get(x)), ("long", lambda x: {"x": 2**40, "y": 7}.get(x)), ("array<int>", lambda x: {"x": [1], "y": [2]}.get(x))):
        frame = llm_spark.createDataFrame([(i, v, label(x), "extra") for i, v, x in rows], f"vec_id long, embedding array<double>, label {kind}, cell string")
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(frame).collect()}
        assert got == {1: (1, 1, True), 2: (1, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6)}}


def test_local_components():
    assert local_components(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]
