import random
import re
import tracemalloc

from pyspark.sql import functions as F

from pairwright.llm import decontaminate
from pairwright.llm.decontaminate import Words, contaminated_words, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(text, items, window):
    words, hit, found = low(text), set(), set()
    for item, t in items:
        w = low(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_is_brute_force(llm_spark):
    g = random.Random(3)
    text = lambda n: "".join(g.choice(["aa", "bb", "Cc", "dé", "42"]) + g.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(g.randint(0, 9))) for i in range(12)] + [(3, text(6)), (None, "zz zz zz zz"), (77, None), (78, ""), (79, "solo")]
    docs = [(i, text(g.randint(0, 40)), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (100, "zz zz zz zz zz", None), (None, "x solo " * 3, "x"), (None, "x solo " * 3, "x"), (102, "é" * 50_000, "x")]
    frame = llm_spark.createDataFrame(docs, "doc_id long, text string, n_hit string")  # a clashing name
    bench = llm_spark.createDataFrame(items, "item_id long, text string")
    got = contaminated_words(frame, bench, window=4).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, list(r.item_ids)) == brute(r.text, items, 4), r
        assert r.n_items == len(r.item_ids) and r.contaminated == (r.n_hit > 0)
    assert not any(r.contaminated for r in contaminated_words(frame, bench.limit(0)).collect())
    assert contaminated_words(frame.limit(0), bench).count() == 0


def test_large_benchmark_with_a_shared_window(llm_spark):
    """5 MB of items, of which 20,000 share one window."""
    word = lambda c: F.concat(F.lit("w"), F.abs(F.xxhash64(c) % 50_000).cast("string"))
    shared = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda j: word(F.struct("id", j))), " ")
    bench = llm_spark.range(20_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", own, F.lit(shared)).alias("text"))
    docs = llm_spark.createDataFrame([(1, f"x {shared.upper()} y"), (2, "nothing of it"), (3, shared[:-6])], "doc_id int, text string").withColumn("__items", F.lit("mine"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["__items"]) for r in contaminated_words(docs, bench).collect()}
    assert got == {1: (12, 10, 20_000, "mine"), 2: (3, 0, 0, "mine"), 3: (9, 0, 0, "mine")}


def test_words_of_many_texts():
    g = random.Random(1)
    texts = ["".join(g.choices(["ab", "Cd", " ", "é", "9", "-", "\n", "xyz "], k=g.randint(0, 200))).encode() for _ in range(300)] + [b"w" * 3_000_000 + b" tail", b"ab cd " * 300_000, b""]
    for some in (texts[:300], texts[300:301], texts[301:302], texts, []):
        got = Words.read(some)
        want = [(i, x) for i, t in enumerate(some) for x in words_of(t)]
        assert [(int(o), got.joined[a:b].lower()) for o, a, b in zip(got.of, got.starts, got.ends)] == want
        by = {}
        assert all(by.setdefault(x, h) == h for (_, x), h in zip(want, got.hashes.tolist())) and len(set(by.values())) == len(by)


def test_words_take_little_memory():
    """A group of texts, as a task reads it: the running sums over it aren't held at once, and neither are tables as long."""
    text = b"some words of a text, " * 50_000
    tracemalloc.start()
    try:
        Words.read([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * len(text), peak
    assert decontaminate.POWERS.nbytes + decontaminate.INVERSES.nbytes <= len(text)
