"""Language identification: gradients, windows against a plain loop, and accuracy on rows held out."""

import pickle
import random
import zlib

import numpy as np
import pandas as pd

from pairwright.llm import language as L


def plain_score(p, text):
    """Mean probability over all windows of a text, byte by byte."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    begins = [*range(0, max(len(low) - L.WINDOW, 0), L.WINDOW - L.OVERLAP), max(len(low) - L.WINDOW, 0)]
    every = []
    for at in begins:
        window = low[at : at + L.WINDOW]
        h = []
        for w in L.WIDTHS:
            run = window.ljust(w, b"\0")
            values = [sum(p["byte"][run[i + j]].astype(float) @ p[f"w{w}_{j}"] for j in range(w)) for i in range(len(run) - w + 1)]
            h.append(np.maximum(np.max(values, axis=0), -1e9))
        z = np.maximum(np.concatenate(h) + p["bias"], 0) @ p["out"] + p["out_b"]
        every.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    return np.mean(every, axis=0)


def test_every_window_counts():
    g = random.Random(3)
    p = L.start(4, 1)
    p["bias"] = (np.arange(len(p["bias"])) % 3 * 0.1).astype(np.float32)
    texts = [bytes(g.choices(b"abcdefXYZ \xc3\xa9", k=n)) for n in (1, 2, 3, 5, 100, 255, 256, 257, 508, 509, 510, 762, 3000)]
    texts = [texts[-1], b"", None, *texts]
    got = L.Scorer(pickle.dumps((p, list("abcd"))), batch=5).scores(texts)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_score(p, t) if t else 0, atol=1e-5)


def test_windows_cover_all_runs():
    for n in (1, 255, 256, 257, 509, 510, 1000):
        begins = L.windows_of(n)
        assert all(any(b <= i and i + max(L.WIDTHS) <= b + L.WINDOW for b in begins) for i in range(n - max(L.WIDTHS) + 1))


def test_gradients():
    g = np.random.default_rng(6)
    p = {k: v.astype(float) for k, v in L.start(3, 2).items()}
    windows, sizes, y = g.integers(97, 103, (L.WINDOW, 5)), np.array([L.WINDOW, 40, 3, 2, 1]), np.array([0, 1, 2, 1, 0])
    windows[np.arange(L.WINDOW)[:, None] >= sizes] = 0

    def loss():
        z = L.softmax(L.pooled(L.tap_tables(p), p["bias"], windows, sizes) @ p["out"] + p["out_b"])
        return -np.log(z[np.arange(5), y]).mean()

    for name, d in L.gradients(p, windows, sizes, y).items():
        for at in [tuple(x) for x in g.permutation(np.argwhere(np.abs(d) > 1e-4))[:5]]:
            keep = p[name][at]
            p[name][at] = keep + 1e-5
            up = loss()
            p[name][at] = keep - 1e-5
            down = loss()
            p[name][at] = keep
            assert abs((up - down) / 2e-5 - d[at]) < 1e-3 + 0.02 * abs(d[at]), name


SOUNDS = {"aa": ["ba", "ko", "lu", "mi"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["ción", "el", "ñ", "os"]}
ROWS = [(9001, None, "aa"), (9002, "", "aa"), (9003, " 12 !?\n", "bb"), (9004, "x" * 100_000, None), (None, "ba ko lu mi ba ko", "aa"), (9005, "schung ein " * 20_000, None)]


def test_rows(llm_spark):
    g = random.Random(2)
    rows = []
    for i in range(400):
        lang = g.choice(sorted(SOUNDS))
        rows.append((i, " ".join("".join(g.choices(SOUNDS[lang], k=3)) for _ in range(g.randint(2, 120))), lang))
    rows += [rows[4], rows[4]]
    docs = llm_spark.createDataFrame(rows + ROWS, "doc_id long, text string, lang string").selectExpr("*", "'clash' AS score", "1 AS got")
    said = L.identify(docs, L.language_model(docs, per_language=100))
    assert said.columns == ["doc_id", "text", "lang", "got", "lang_pred", "score"]
    got = said.collect()
    assert len(got) == len(rows) + len(ROWS) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[9001] == by[9002] == by[9003] == ("und", 0.0) and by[9005][0] == "bb" and by[None][0] == "aa"
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) == 1


def test_sample_is_bounded_and_never_held_out(llm_spark):
    rows = [(i, "a" * (i % 50 + 1), "big" if i % 10 else "small") for i in range(4000)] + [(1, "zz", None), (None, "b", "big"), (77, None, "big")] + [(79, "twice", "big")] * 2000
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.labelled_texts(docs, 200, 64, 10).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and len(r.text) <= 10 for r in got) and len({r.doc_id for r in got}) == len(got)
    assert 120 <= sum(r.y == "small" for r in got) <= 280 and sum(r.y == "big" for r in got) <= 280
    assert {r.y for r in L.labelled_texts(docs, 200, 1, 10).collect()} == {"big"}


def test_nothing_to_learn_from(llm_spark):
    docs = llm_spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(docs, L.language_model(docs)).collect()] == [("und", 0.0)]
    one = llm_spark.createDataFrame([(i, "only one", "xx") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.identify(one, L.language_model(one)).collect()} == {("xx", 1.0)}
    assert L.identify(docs.limit(0), L.language_model(docs.limit(0))).count() == 0
    assert L.fit(pd.DataFrame({"doc_id": [], "text": [], "y": []}))
