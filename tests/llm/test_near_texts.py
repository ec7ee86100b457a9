"""Near-duplicate texts against brute force, and the pipeline's promise that none stay."""

import random
import time

import corpus_pipeline
from pyspark.sql import functions as F

from pairwright.llm import near_texts
from pairwright.llm.near_texts import keep_one_text, near_links


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} - {()}


def near(a, b):
    a, b = grams(a), grams(b)
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def left(rows):
    """The ids that single linkage leaves."""
    root = {d: d for d, _ in rows}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if root[a] != root[b] and near(x, y):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d for d, r in root.items() if d == r}


def corpus():
    g = random.Random(3)
    words = [f"w{i}é" for i in range(3000)]
    line = g.choices(words, k=15)
    rows = []
    for _ in range(12):
        base = g.choices(words, k=g.choice([6, 40, 200, 300])) + line
        rows.append(base)
        for edits in (1, 2, 4, 5, 6, 8, 12):
            other = list(base)
            for at in g.sample(range(len(other)), min(edits, len(other))):
                other[at] = g.choice(words)
            rows += [other, other[: int(len(other) * g.uniform(0.75, 1))]]
    group = g.choices(words, k=150)
    for _ in range(90):
        other = list(group)
        for at in g.sample(range(150), 2):
            other[at] = g.choice(words)
        rows.append(other)
    return [(k, " ".join(w)) for k, w in enumerate(rows)] + [(9001, "one two"), (9002, " One\ttwo"), (9003, "one two three"), (9004, ""), (9005, None)]


def test_keep_one_text(llm_spark):
    rows = corpus()
    docs = llm_spark.createDataFrame([*rows, (None, rows[0][1] + " x"), rows[0]], "doc_id long, text string")
    kept = [r.doc_id for r in keep_one_text(docs).collect()]
    assert {d for d in kept if d is not None} == left(rows) and kept.count(None) == 0 and kept.count(0) == 2
    assert keep_one_text(docs.limit(0)).count() == 0


def test_blocks_and_hubs(llm_spark):
    rows = corpus()
    texts = llm_spark.createDataFrame(rows, "node long, text string")
    for hub, block in ((64, 2048), (3, 5)):
        root = {d: d for d, _ in rows}
        for a, b in near_links(texts, hub, block).collect():
            assert near(dict(rows)[a], dict(rows)[b])
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
        assert {d for d, r in root.items() if d == r} == left(rows)


def letters(n, own, common, seed=5):
    """Letters of one form: each has ``own`` words of its own among ``common`` ones."""
    g = random.Random(seed)
    form = [f"form{i}" for i in range(common)]
    return [(k, " ".join([f"own{k}x{g.randrange(10**9)}" for _ in range(own)] + form)) for k in range(n)]


def test_letters_of_one_form_do_not_all_meet(llm_spark):
    rows = letters(20_000, 56, 340)
    frame = llm_spark.createDataFrame(rows, "node long, text string").repartition(8)
    keyed = near_texts.prefixes(frame, near_texts.frequent(frame))
    hot = keyed.groupBy("k").count().agg(F.max("count")).first()[0]
    assert hot == 20_000  # all share shingles of their prefixes
    dealt = keyed.withColumns({"c": F.col("node"), "s": F.lit(0), "i": F.lit(0), "j": F.lit(0)}).repartition(4, "k").sortWithinPartitions("k", "i", "j", "n", "node")
    began = time.time()
    assert dealt.mapInPandas(lambda frames: near_texts.meetings(frames, False), "a long, b long, na int, nb int").count() == 0
    assert time.time() - began < 120


def test_meetings_lose_no_link(llm_spark):
    g = random.Random(12)
    form = letters(60, 40, 200) + [(1000 + k, t) for k, t in letters(40, 24, 200, 6)] + [(2000 + k, " ".join(t.split()[: g.randrange(150, 260)])) for k, t in letters(60, 10, 250, 7)]
    links = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(form) for b, y in form[:i] if near(x, y)}
    frame = llm_spark.createDataFrame(form, "node long, text string")
    keyed = near_texts.prefixes(frame, near_texts.frequent(frame)).withColumns({"c": F.col("node"), "s": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    ready = keyed.repartition(3, "k").sortWithinPartitions("k", "i", "j", "n", "node")
    for most in (1 << 20, 7):
        met = ready.mapInPandas(lambda frames, most=most: near_texts.meetings(frames, False, most), "a long, b long, na int, nb int")
        assert links <= {(r.a, r.b) for r in met.select("a", "b").distinct().collect()}
    assert {(r.a, r.b) for r in near_texts.verified(frame, met, keyed).collect()} == links and len(links) > 100


def test_no_near_texts_stay(llm_spark, sf, tmp_path):
    docs = llm_spark.read.parquet(f"{sf}/documents.parquet")
    stages = [s for _, s in corpus_pipeline.STAGES]
    for k, stage in enumerate(stages[1:3]):
        stage(llm_spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = llm_spark.read.parquet(f"{tmp_path}/{k}")
    texts = [r.text for r in docs.select("text").collect()]
    assert not any(near(x, y) for i, x in enumerate(texts) for y in texts[:i])
