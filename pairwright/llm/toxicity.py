"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import labelled_sample, shared, train_in_task

WINDOW, STRIDE = 24, 4  # words; a window begins at every fourth word, so neighbours share 20 words
BUCKETS, WIDTH, HIDDEN = 1 << 15, 8, 8  # of each of the two embeddings, and of each direction
GRAMS = (3, 4, 5)
PIECE = re.compile(rb"[^\x20\x09-\x0D]{1,24}")  # longer words are several pieces
NO_WORDS = -4.0  # logit of a text without words
MARKS = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def pieces(text: str | None) -> list[bytes]:
    """The words of the whole text, lower-cased."""
    return PIECE.findall((text or "").lower().encode("utf-8", "replace"))


def gram_slots(raw: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all runs of n bytes of each row."""
    h = np.full((len(raw), raw.shape[1] - n + 1), n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + raw[:, i : raw.shape[1] - n + 1 + i]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its bucket, and the buckets of its character n-grams with a mask."""
    bare = [w.strip(MARKS) or w for w in words]
    slot = np.array([zlib.crc32(w) % BUCKETS for w in bare], np.int64)
    wide = max(map(len, bare), default=1) + 2
    raw = np.frombuffer(b"".join((b"<" + w + b">").ljust(wide, b"\0") for w in bare), np.uint8).reshape(len(bare), wide).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in bare])
    grams, masks = [], []
    for n in GRAMS:
        if wide < n:
            continue
        grams.append(gram_slots(raw, n))
        masks.append(np.arange(wide - n + 1)[None] <= (sizes - n)[:, None])
    return slot, np.concatenate(grams, axis=1), np.concatenate(masks, axis=1)


def embed(p: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Word embedding and root-scaled sum of n-gram embeddings, side by side; words of one length go together."""
    bare = [w.strip(MARKS) or w for w in words]
    out = np.empty((len(words), 2 * WIDTH), np.float32)
    out[:, :WIDTH] = p["word"][np.fromiter(map(zlib.crc32, bare), np.int64, len(bare)) % BUCKETS]
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    for size in np.unique(sizes).tolist():
        every = np.flatnonzero(sizes == size)
        for some in np.split(every, range(4000, len(every), 4000)):
            raw = np.frombuffer(b"".join([b"<" + bare[i] + b">" for i in some.tolist()]), np.uint8).reshape(len(some), size + 2).astype(np.uint64)
            total, n_grams = np.zeros((len(some), WIDTH), np.float32), 0
            for n in (n for n in GRAMS if n <= size + 2):
                at = gram_slots(raw, n)
                total += p["gram"][at].sum(axis=1)
                n_grams += at.shape[1]
            out[some, WIDTH:] = total / np.sqrt(max(n_grams, 1))
    return out


def windows_of(n: int) -> range:
    """Where the windows over n words begin: at every ``STRIDE``th word, until one holds the last word."""
    return range(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n else range(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gates(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, backward: bool, keep: bool = False):
    """Hidden states (T, B, HIDDEN) for input gates (T, B, 3 * HIDDEN); words out of the mask leave the state as it is."""
    steps, batch, _ = gates.shape
    h, out, cache = np.zeros((batch, HIDDEN), np.float32), np.empty((steps, batch, HIDDEN), np.float32), [None] * steps
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        a = h @ u
        zr = sigmoid(gates[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        z = np.where(mask[t], z, 1.0).astype(np.float32)
        if keep:
            cache[t] = (h, z, r, n, a[:, 2 * HIDDEN :])
        h = n + z * (h - n)
        out[t] = h
    return (out, cache) if keep else out


def pool(p: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray):
    """Logits (B,), attention (T, B), and tanh of the attention layer."""
    k = np.tanh(states @ p["att"] + p["att_b"])
    e = np.where(mask[..., 0], k @ p["att_v"], -30.0)
    e = np.exp(e - e.max(axis=0))
    weight = e / e.sum(axis=0)
    return (weight[..., None] * states).sum(axis=0) @ p["out"] + p["out_b"], weight, k


def start(seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    new = lambda *s, by=0.3: (g.standard_normal(s) * by).astype(np.float32)
    p = {"word": new(BUCKETS, WIDTH, by=0.05), "gram": new(BUCKETS, WIDTH, by=0.05), "att": new(2 * HIDDEN, HIDDEN), "att_b": np.zeros(HIDDEN, np.float32), "att_v": new(HIDDEN), "out": new(2 * HIDDEN), "out_b": np.zeros((), np.float32)}
    for d in "fb":
        p |= {f"w{d}": new(2 * WIDTH, 3 * HIDDEN), f"u{d}": new(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


class Scorer:
    """Scores whole texts; keeps the gates' inputs of words it has met, up to ``most_words``.

    Texts lie behind each other, each followed by padding that leaves states as they are, and all begin at a multiple of the
    stride, so the words at one step of neighbouring windows are a plain slice and many windows run as one batch.
    """

    PAD, BATCH = 0, 1024

    def __init__(self, p: dict[str, np.ndarray], most_words: int = 60_000):
        self.p, self.most, self.rows = p, most_words, {}
        # a sigmoid is a tanh of half its input
        self.half = np.tile(np.repeat(np.float32([0.5, 1]), [2 * HIDDEN, HIDDEN]), 2)
        self.w, self.c = np.concatenate([p["wf"], p["wb"]], axis=1), np.concatenate([p["cf"], p["cb"]])
        self.u = [np.ascontiguousarray((p[f"u{d}"] * self.half[: 3 * HIDDEN]).T) for d in "fb"]
        self.table = self.empty(most_words * 2)

    def empty(self, n: int) -> np.ndarray:
        table = np.zeros((n, 6 * HIDDEN), np.float32)
        table[self.PAD, :HIDDEN] = table[self.PAD, 3 * HIDDEN : 4 * HIDDEN] = 30  # keeps the state
        return table

    def codes(self, words: list[bytes]) -> np.ndarray:
        fresh = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(fresh) > len(self.table) - 1:
            self.rows = {}
            fresh = list(dict.fromkeys(words))
            if len(fresh) > len(self.table) - 1:
                self.table = self.empty(len(fresh) + 1)
        if fresh:
            first = len(self.rows) + 1  # row 0 is padding
            self.rows.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            self.table[first : first + len(fresh)] = (embed(self.p, fresh) @ self.w + self.c) * self.half
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def windows(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logit, text, first word) of every window of every text with words."""
        sizes = np.array([len(t) for t in texts], np.int64)
        room = -(-sizes // STRIDE) * STRIDE + np.where(sizes > 0, WINDOW, 0)
        begins = np.cumsum(room) - room
        total = int(room.sum())
        coded = np.full(-(-total // STRIDE) * STRIDE + WINDOW, self.PAD, np.int64)
        coded[np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)] = self.codes([w for t in texts for w in t])
        each = [windows_of(n) for n in sizes]
        of = np.repeat(np.arange(len(texts)), [len(e) for e in each])
        first = np.concatenate([np.empty(0, np.int64), *(np.arange(e.start, e.stop, e.step) for e in each if len(e))]).astype(np.int64)
        # by place in the stride, then by gate, then by window, so that a step of a batch lies together
        gates = np.ascontiguousarray(self.table[coded].reshape(-1, STRIDE, 6 * HIDDEN).transpose(1, 2, 0))
        real = np.ascontiguousarray((coded != self.PAD).reshape(-1, STRIDE).T)
        out = np.empty(max(total // STRIDE, 0), np.float32)
        for at in range(0, len(out), self.BATCH):
            out[at : at + self.BATCH] = self._logits(gates, real, at, min(self.BATCH, len(out) - at))
        return out[(begins[of] + first) // STRIDE], of, first

    def _logits(self, gates: np.ndarray, real: np.ndarray, at: int, n: int) -> np.ndarray:
        p, states = self.p, np.empty((WINDOW, 2 * HIDDEN, n), np.float32)
        for k, u in enumerate(self.u):
            h = np.zeros((HIDDEN, n), np.float32)
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                lo = at + t // STRIDE
                x, a = gates[t % STRIDE, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1), lo : lo + n], u @ h
                zr = np.tanh(x[: 2 * HIDDEN] + a[: 2 * HIDDEN])
                zr *= 0.5
                zr += 0.5
                new = np.tanh(x[2 * HIDDEN :] + zr[HIDDEN:] * a[2 * HIDDEN :])
                h = new + zr[:HIDDEN] * (h - new)
                states[t, HIDDEN * k : HIDDEN * (k + 1)] = h
        e = np.matmul(p["att_v"], np.tanh(np.matmul(p["att"].T, states) + p["att_b"][:, None]))  # (WINDOW, n)
        inside = np.stack([real[t % STRIDE, at + t // STRIDE : at + t // STRIDE + n] for t in range(WINDOW)])
        e = np.where(inside, e, -30.0)
        e = np.exp(e - e.max(axis=0))
        said = np.matmul(p["out"], states)
        return (said * e).sum(axis=0) / e.sum(axis=0) + p["out_b"]

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """The highest window logit of each text; a text without words, which says nothing, gets ``NO_WORDS`` or less."""
        out = np.full(len(texts), -np.inf)
        at = 0
        while at < len(texts):  # texts together, up to some 50,000 words
            end, total = at, 0
            while end < len(texts) and (end == at or total + len(texts[end]) <= 50_000):
                total += len(texts[end])
                end += 1
            logits, of, _ = self.windows(texts[at:end])
            np.maximum.at(out, of + at, logits)
            at = end
        return np.where(np.isinf(out), min(float(self.p["out_b"]), NO_WORDS), out)


def gradients(p: dict[str, np.ndarray], words: list[bytes], index: np.ndarray, size: np.ndarray, y: np.ndarray, known: np.ndarray, toxic_weight: float = 1.0) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over windows; index (T, B) into words; words not ``known`` show their characters only."""
    slot, grams, gmask = word_inputs(words)
    share = gmask / np.sqrt(np.maximum(gmask.sum(axis=1), 1))[:, None]
    x = np.concatenate([p["word"][slot] * known[:, None], (p["gram"][grams] * share[..., None]).sum(axis=1)], axis=1).astype(np.float32)
    mask = (np.arange(WINDOW)[:, None] < size)[..., None]
    inputs = x[index]
    hf, kf = run_gates(inputs @ p["wf"] + p["cf"], p["uf"], mask, False, True)
    hb, kb = run_gates(inputs @ p["wb"] + p["cb"], p["ub"], mask, True, True)
    states = np.concatenate([hf, hb], axis=2)
    logit, weight, k = pool(p, states, mask)
    d = ((sigmoid(logit) - y) * np.where(y > 0, toxic_weight, 1.0) / len(y)).astype(np.float32)
    pooled = (weight[..., None] * states).sum(axis=0)
    g = {"out": pooled.T @ d, "out_b": d.sum()}
    d_pooled = d[:, None] * p["out"]
    d_states = weight[..., None] * d_pooled
    d_weight = (states * d_pooled).sum(axis=2)
    d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_k = d_e[..., None] * p["att_v"] * (1 - k * k)
    g |= {"att_v": (k * d_e[..., None]).sum(axis=(0, 1)), "att": np.einsum("tbi,tbj->ij", states, d_k), "att_b": d_k.sum(axis=(0, 1))}
    d_states = d_states + d_k @ p["att"].T
    d_x = np.zeros_like(inputs)
    for name, cache, backward, part in (("f", kf, False, slice(0, HIDDEN)), ("b", kb, True, slice(HIDDEN, None))):
        u, w = p[f"u{name}"], p[f"w{name}"]
        gu, gc = np.zeros_like(u), np.zeros((WINDOW, len(y), 3 * HIDDEN), np.float32)
        dh = np.zeros((len(y), HIDDEN), np.float32)
        for t in range(WINDOW) if backward else range(WINDOW - 1, -1, -1):
            h, z, r, n, a = cache[t]
            dh = dh + d_states[t, :, part]
            dz = dh * (h - n) * z * (1 - z)
            dn = dh * (1 - z) * (1 - n * n)
            dr = dn * a * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            gu += h.T @ da
            gc[t] = np.concatenate([dz, dr, dn], axis=1)
            dh = dh * z + da @ u.T
        g |= {f"u{name}": gu, f"c{name}": gc.sum(axis=(0, 1)), f"w{name}": np.einsum("tbi,tbj->ij", inputs, gc)}
        d_x += gc @ w.T
    d_words = np.zeros_like(x)
    np.add.at(d_words, index.ravel(), (d_x * mask).reshape(-1, 2 * WIDTH))
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], slot, d_words[:, :WIDTH] * known[:, None])
    np.add.at(g["gram"], grams, share[..., None].astype(np.float32) * d_words[:, None, WIDTH:])
    return g


def fit(sample: pd.DataFrame, rounds: int = 6, batch: int = 128, least_steps: int = 200, rate: float = 0.01, decay: float = 1e-4, unknown: float = 0.3, toxic_weight: float = 2.0, seed: int = 3) -> bytes:
    """The network of a bounded sample (text, y), as bytes.

    A toxic document is taken to be toxic in its highest-scoring windows only, so in each round but the first the network
    scores all overlapping windows and learns from the highest one of each document, and from one random window of clean
    ones; the first round draws windows. All parameters start at random.
    Few documents make small batches and more rounds, so that there are at least ``least_steps`` updates. Without both
    classes the network is constant.
    """
    g = np.random.default_rng(seed)
    texts, y = [pieces(t) for t in sample["text"]], sample["y"].to_numpy(np.float32)
    p = start(seed)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        p["out"][:] = 0
        p["out_b"] = np.float32(np.log(share / (1 - share)))
        return pickle.dumps(p)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step, some = 0, sum(map(bool, texts)) + int((y == 0).sum())
    batch = min(batch, max(16, some // 16))
    rounds = max(rounds, -(-least_steps * batch // some))
    for turn in range(rounds):
        scorer, chosen = Scorer(p), []
        for at in range(0, len(texts), 100):
            logits, of, begins = scorer.windows(texts[at : at + 100])
            for i in np.unique(of):
                own = np.flatnonzero(of == i)
                # nothing is known at first, so the first windows are drawn
                best = own[logits[own].argmax()] if turn else g.choice(own)
                chosen.append((at + int(i), int(begins[best])))
        chosen += [(i, int(g.choice(windows_of(len(texts[i]))))) for i, _ in chosen if not y[i]]
        order = g.permutation(len(chosen))
        for at in range(0, len(order), batch):
            part = [chosen[j] for j in order[at : at + batch]]
            runs = [texts[i][s : s + WINDOW] for i, s in part]
            words = list(dict.fromkeys(w for r in runs for w in r))
            number = {w: k for k, w in enumerate(words)}
            index = np.array([[number[w] for w in r] + [0] * (WINDOW - len(r)) for r in runs]).T
            grads = gradients(p, words, index, np.array([len(r) for r in runs]), y[[i for i, _ in part]], (g.random(len(words)) >= unknown).astype(np.float32), toxic_weight)
            step += 1
            for k, d in grads.items():
                d = d + decay * p[k] if k not in ("out_b",) else d
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                p[k] = (p[k] - rate * (1 - turn / rounds) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return pickle.dumps(p)


def toxicity_model(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 3000) -> bytes:
    """Trained from at most so many labelled documents of each class that aren't held out."""
    return train_in_task(labelled_sample(docs, labels, "toxic", {0: most_clean, 1: most_toxic}), fit)


def score_toxicity(docs: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """Adds score (0 to 1, higher: more toxic) and predicted (1 if score >= ``threshold``) to every row of ``docs`` (text).

    All overlapping windows of 24 words are scored, one of which begins at every ``STRIDE``th word of the whole text, alike
    for all texts; the score is that of the highest window. Null and empty texts have no window and a score under 0.02, so
    they are never predicted toxic; ties have equal scores. Only the text counts; rows are kept as they are; other columns
    stay and those of the two names are replaced.
    """
    base = docs.drop("score", "predicted")
    held = shared(docs.sparkSession, model)
    scorers: list[Scorer] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not scorers:
            scorers.append(Scorer(pickle.loads(held())))
        out = np.empty(len(texts))
        for at in range(0, len(texts), 500):
            out[at : at + 500] = scorers[0].scores([pieces(t) for t in texts[at : at + 500]])
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    scored = base.withColumn("score", score("text"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
