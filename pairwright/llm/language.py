"""Language identification: a byte convolutional network with filters of several widths, max pooling and softmax, in numpy."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import shared, train_in_task, unused

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 8  # filters of each width, numbers of a byte
OVERLAP = max(WIDTHS) - 1  # bytes that neighbouring windows share, so that every run of bytes lies whole in one
TAPS = [(w, j) for w in WIDTHS for j in range(w)]
#: A-Z become a-z; other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
UNKNOWN = "und"


def start(languages: int, seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p = {"byte": g.standard_normal((256, EMBED)) * 0.5, "out": g.standard_normal((len(WIDTHS) * FILTERS, languages)) * 0.1, "out_b": np.zeros(languages), "bias": np.zeros(len(WIDTHS) * FILTERS)}
    for w, j in TAPS:
        p[f"w{w}_{j}"] = g.standard_normal((EMBED, FILTERS)) / np.sqrt(EMBED * w)
    return {k: v.astype(np.float32) for k, v in p.items()}


def tap_tables(p: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """For each place in a filter (256, FILTERS): what each byte adds there, so that a convolution is a sum of lookups."""
    return {(w, j): p["byte"] @ p[f"w{w}_{j}"] for w, j in TAPS}


def pooled(tables: dict[tuple[int, int], np.ndarray], bias: np.ndarray, windows: np.ndarray, sizes: np.ndarray | None = None, places: bool = False):
    """(B, filters): the highest value of each filter over all its places in each window (WINDOW, B), at least 0.

    ``sizes``: how many bytes of each window count, if not all; a filter that is wider has its first place. With
    ``places`` also where the highest value stands.
    """
    out, at = [], []
    for w in WIDTHS:
        n = len(windows) - w + 1
        total = tables[w, 0].take(windows[:n], axis=0)  # (n, B, FILTERS)
        more = np.empty_like(total)
        for j in range(1, w):
            tables[w, j].take(windows[j : j + n], axis=0, out=more, mode="clip")
            total += more
        if sizes is not None:
            total[np.arange(n)[:, None] >= np.maximum(sizes - w + 1, 1)] = -np.inf
        out.append(total.max(axis=0))
        if places:
            at.append(total.argmax(axis=0))
    high = np.maximum(np.concatenate(out, axis=1) + bias, 0)
    return (high, np.concatenate(at, axis=1)) if places else high


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain_bytes(text: bytes | None) -> np.ndarray:
    return LOWER[np.frombuffer(text or b"", np.uint8)]


def windows_of(n: int) -> list[int]:
    """Where the windows over n bytes begin; the last one ends with the text, and a short text has one."""
    return [*range(0, max(n - WINDOW, 0), WINDOW - OVERLAP), max(n - WINDOW, 0)] if n else []


def gradients(p: dict[str, np.ndarray], windows: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over windows; a filter learns at its highest place alone."""
    h, at = pooled(tap_tables(p), p["bias"], windows, sizes, True)
    d = softmax(h @ p["out"] + p["out_b"])
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    g = {"out": h.T @ d, "out_b": d.sum(axis=0)}
    d_h = (d @ p["out"].T) * (h > 0)
    g["bias"], g["byte"] = d_h.sum(axis=0), np.zeros_like(p["byte"])
    column = np.arange(len(y))[:, None]
    for w, j in TAPS:
        part = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
        byte = windows[np.minimum(at[:, part] + j, len(windows) - 1), column]  # (B, FILTERS)
        each = np.zeros((256, FILTERS), np.float32)  # by byte, what arrives at each filter
        np.add.at(each, (byte, np.arange(FILTERS)[None]), d_h[:, part])
        g[f"w{w}_{j}"] = p["byte"].T @ each
        g["byte"] += each @ p[f"w{w}_{j}"].T
    return g


def fit(sample: pd.DataFrame, rounds: int = 12, batch: int = 32, least_steps: int = 800, rate: float = 0.005, decay: float = 1e-4, seed: int = 4) -> bytes:
    """(network, languages) of a bounded sample (text bytes, y: language), as bytes.

    In each round every text gives one window, drawn anew; a third of them are cut to a drawn length, as short texts are.
    Few texts make more rounds, so that there are at least ``least_steps`` updates. Without texts there is no language.
    """
    g = np.random.default_rng(seed)
    names = sorted(set(sample["y"])) if len(sample) else []
    p = start(len(names), seed)
    texts = [plain_bytes(t) for t in sample["text"]] if names else []
    known = [i for i, t in enumerate(texts) if len(t)]
    y = np.array([names.index(v) for v in sample["y"]], np.int64) if names else np.empty(0, np.int64)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    rounds = max(rounds, -(-least_steps * batch // len(known))) if len(names) > 1 and known else 0
    total = rounds * -(-len(known) // batch)
    for _ in range(rounds):
        order = g.permutation(known)
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            windows, sizes = np.zeros((WINDOW, len(part)), np.intp), np.empty(len(part), np.int64)
            for b, i in enumerate(part):
                n = min(len(texts[i]), WINDOW if g.random() < 2 / 3 else int(g.integers(8, WINDOW)))
                at = int(g.integers(len(texts[i]) - n + 1))
                windows[:n, b], sizes[b] = texts[i][at : at + n], n
            step += 1
            for k, d in gradients(p, windows, sizes, y[part]).items():
                d = d + decay * p[k] if k not in ("out_b", "bias") else d
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                p[k] = (p[k] - rate * (1 - (step - 1) / total) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return pickle.dumps((p, names))


def not_learnt(doc_id: str) -> Column:
    """True for the quarter of the rows that the network may not learn from; a null id is among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def labelled_texts(docs: DataFrame, per_language: int, most_languages: int, most_chars: int) -> DataFrame:
    """(doc_id, text, y): about ``per_language`` documents of each of the ``most_languages`` largest languages, picked by the
    hash of their ids, and of each a run of at most ``most_chars`` that begins where the hash says.

    Only documents with an id, a text and a language that aren't held out count; of those of one id and language the first
    by text counts.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~not_learnt("doc_id")).select("doc_id", "text", F.col("lang").cast("string").alias("y"))
    sizes = rows.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(most_languages)
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    picked = rows.join(F.broadcast(sizes.select("y", share.alias("share"))), "y").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    begin = F.pmod(F.xxhash64("doc_id", "y"), F.greatest(F.length("text") - most_chars, F.lit(0)) + 1).cast("int")
    run = F.substring(F.col("text"), begin + 1, F.lit(most_chars))
    return picked.groupBy("doc_id", "y").agg(F.min(run.cast("binary")).alias("text")).select("doc_id", "text", "y")


def language_model(docs: DataFrame, per_language: int = 1000, most_languages: int = 64, most_chars: int = 2048) -> bytes:
    """Trained in one task from a bounded sample of ``docs`` (doc_id, text, lang); see ``labelled_texts``."""
    return train_in_task(labelled_texts(docs, per_language, most_languages, most_chars), fit)


class Scorer:
    """Probabilities of whole texts: the mean over all their windows."""

    def __init__(self, model: bytes, batch: int = 32):
        self.p, self.names = pickle.loads(model)
        self.tables, self.batch = tap_tables(self.p), batch

    def windows(self, windows: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """(B, languages) for windows (B, WINDOW)."""
        return softmax(pooled(self.tables, self.p["bias"], np.ascontiguousarray(windows.T).astype(np.intp), sizes) @ self.p["out"] + self.p["out_b"])

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """(texts, languages); a text without bytes has zeros."""
        out = np.zeros((len(texts), len(self.names)))
        short, whole, queued = [], [], 0
        for i, t in enumerate(map(plain_bytes, texts)):
            if not len(t):
                continue
            if len(t) < WINDOW:
                short.append((i, t))
                continue
            begins = windows_of(len(t))
            for lo in range(0, len(begins), 256 * self.batch):  # of a long text, some windows at a time
                part = np.array(begins[lo : lo + 256 * self.batch])
                whole.append((i, 1 / len(begins), np.lib.stride_tricks.sliding_window_view(t, WINDOW)[part]))
                queued += len(part)
                if queued >= 256 * self.batch:
                    self._add(out, whole)
                    whole, queued = [], 0
        self._add(out, whole)
        for lo in range(0, len(short), self.batch):
            part = short[lo : lo + self.batch]
            padded = np.zeros((len(part), WINDOW), np.uint8)
            for row, (_, t) in zip(padded, part, strict=True):
                row[: len(t)] = t
            out[[i for i, _ in part]] = self.windows(padded, np.array([len(t) for _, t in part]))
        return out

    def _add(self, out: np.ndarray, whole: list[tuple[int, float, np.ndarray]]) -> None:
        if not whole:
            return
        every = np.concatenate([w for _, _, w in whole])
        of, share = np.repeat([i for i, _, _ in whole], [len(w) for _, _, w in whole]), np.repeat([s for _, s, _ in whole], [len(w) for _, _, w in whole])
        for lo in range(0, len(every), self.batch):
            hi = lo + self.batch
            np.add.at(out, of[lo:hi], self.windows(every[lo:hi]) * share[lo:hi, None])


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row of ``docs`` (text).

    The whole text is cut into windows of 256 bytes that overlap by three, the last ending with the text; a language's score is
    the mean of its probability over all windows, and the highest one is told, ties by the order of the names. A text that is null or has no letter, and every
    text where no language was learnt, is ``und`` with score 0. Rows are kept as they are, repeated ones have equal
    results; other columns stay and those of the two names are replaced.
    """
    base = docs.drop("lang_pred", "score")
    held, got = shared(docs.sparkSession, model), unused(base, "got")
    scorers: list[Scorer] = []

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not scorers:
            scorers.append(Scorer(held()))
        names = scorers[0].names
        if not names:
            return pd.DataFrame({"lang": [None] * len(texts), "score": 0.0})
        p = scorers[0].scores(list(texts))
        return pd.DataFrame({"lang": [names[k] for k in p.argmax(axis=1)], "score": np.minimum(p.max(axis=1), 1.0)})

    said = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.col(f"{got}.lang").isNotNull()
    scored = base.withColumn(got, predict(F.col("text").cast("binary")))
    return scored.select(*base.columns, F.when(said, F.col(f"{got}.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(said, F.col(f"{got}.score")).otherwise(0.0).alias("score"))
