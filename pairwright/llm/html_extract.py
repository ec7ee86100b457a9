"""Main text of web pages: a bidirectional LSTM in numpy labels every leaf block, seeing the whole page."""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import sample_by_id, shared, train_in_task

#: What follows a tag's name up to its end; a ">" in quotes doesn't end it.
TAG_REST = re.compile(r"(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Fixed values of the HTML language.
RAW = frozenset("script style textarea iframe noembed noframes".split())  # end at their end tag, or with the page
HIDDEN_PARTS = frozenset("noscript template svg select".split())  # hidden up to their end tag, if there is one
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li body".split())
END_TAG = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW | HIDDEN_PARTS}

PATH, WORDS, STATS, CONTEXT = 160, 32, 8, 4
WIDTH, HIDDEN = PATH + WORDS + STATS + CONTEXT, 20


class Place:
    """An open element and its ancestors; like elements of one parent share it, so a page's paths take little memory."""

    __slots__ = ("parent", "tag", "words", "children", "fresh", "vector")

    def __init__(self, parent: Place | None, words: tuple[str, ...], fresh: tuple[str, ...]):
        self.parent, self.tag, self.words, self.fresh = parent, words[0] if words else "", words, fresh
        self.children: dict[tuple[str, ...], Place] = {}
        self.vector: np.ndarray | None = None

    def __iter__(self) -> Iterator[str]:
        line, at = [], self
        while at is not None:
            line.append(at.words)
            at = at.parent
        return (w for words in reversed(line) for w in words)


class Block(NamedTuple):
    path: Place | tuple[str, ...]  # the open tags and their class, id and role words, from the root
    text: str


def words_of_tag(tag: str, rest: str) -> tuple[str, ...]:
    """A tag and the words of its class, id and role."""
    words = [tag]
    for n in NAMED.finditer(rest):
        words += [f"{tag}.{w}" for w in re.split(r"[\s_-]+", (n[1] or n[2] or n[3] or "").lower()) if w]
    return tuple(words)


class Stack:
    """The open elements. How often each tag and token is open is counted, so nothing walks a deep stack in vain."""

    def __init__(self) -> None:
        self.at = Place(None, (), ())
        self.tags: Counter[str] = Counter()
        self.tokens: Counter[str] = Counter()

    def open(self, words: tuple[str, ...]) -> None:
        child = self.at.children.get(words)
        if child is None:
            own = dict.fromkeys((*words, *(w.rpartition(".")[2] for w in words if "." in w)))
            child = self.at.children[words] = Place(self.at, words, tuple(w for w in own if not self.tokens[w]))
        self.at = child
        self.tags[child.tag] += 1
        self.tokens.update(child.fresh)

    def pop(self) -> None:
        self.tags[self.at.tag] -= 1
        self.tokens.subtract(self.at.fresh)
        self.at = self.at.parent

    def close(self, tag: str) -> None:
        """Ends the innermost element of this tag and all inside it; without one, nothing."""
        if self.tags[tag]:
            while self.at.tag != tag:
                self.pop()
            self.pop()


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: runs of text without a block-level tag in between.

    Character references are decoded, white space is turned into one space and trimmed; empty blocks are left out. What
    raw elements (script, style, ...) and comments hold is skipped, to the end of the page if they don't end. svg, select,
    template and noscript are skipped if they end; else only their tag. A tag that the page's end cuts off is dropped.
    Time and memory are in proportion to the page.
    """
    out: list[Block] = []
    stack, run, page = Stack(), [], page or ""
    endless: set[str] = set()  # hidden elements without an end tag from here on
    at = 0

    def flush() -> None:
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                out.append(Block(stack.at, text))
            run.clear()

    def start_tag(tag: str, rest: str, after: int) -> int:
        """Opens an element; gives where reading goes on."""
        closed = rest.endswith("/>")
        if (tag in RAW or (tag in HIDDEN_PARTS and not closed)) and tag not in endless:
            if end := END_TAG[tag].search(page, after):
                return end.end()
            if tag in RAW:
                return len(page)
            endless.add(tag)
        if tag in INLINE:
            if tag in ("br", "img"):
                run.append(" ")
            return after
        flush()
        if tag in NO_PARAGRAPH:
            stack.close("p")
        if stack.at.tag in CLOSED_BY.get(tag, ()):
            stack.pop()
        if tag not in VOID and not closed:
            stack.open(words_of_tag(tag, rest))
        return after

    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            run.append(page[at:lt])
        sign = page[lt + 1 : lt + 2]
        if sign in ("!", "?"):
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + (4 if comment else 2))
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        name = NAME.match(page, lt + 1 + (sign == "/"))
        if name is None:
            run.append("<")
            at = lt + 1
            continue
        rest = TAG_REST.match(page, name.end())
        end = rest.end() if rest else page.find(">", name.end()) + 1  # quotes that don't end don't count
        if not end:
            at = len(page)
            break
        tag = name[0].lower()
        if sign != "/":
            at = start_tag(tag, page[name.end() : end], end)
        else:
            at = end
            if tag not in INLINE:
                flush()
                stack.close(tag)
    run.append(page[at:])
    flush()
    return out


def _slot(token: str, width: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return (h >> 1) % width, 1.0 if h & 1 else -1.0


class Hashed(dict):
    """Word -> twice its slot, plus 1 for a positive sign; cleared when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        slot, sign = _slot(word, WORDS)
        self[word] = out = 2 * slot + (sign > 0)
        return out


def context(blocks: list[Block]) -> np.ndarray:
    """(n, CONTEXT) figures of a whole page's blocks: the share of its text that has the same path, and the same parent
    element, the block's place, and how many blocks have its path."""
    if not blocks:
        return np.zeros((0, CONTEXT), np.float32)
    own, above, count = Counter(), Counter(), Counter()

    def parent(path: Place | tuple[str, ...]):
        if isinstance(path, Place):
            return path.parent
        return path[: max((i for i, t in enumerate(path) if "." not in t), default=0)]

    each = [(b.path, parent(b.path), len(b.text)) for b in blocks]
    for path, up, n in each:
        own[path] += n
        above[up] += n
        count[path] += 1
    total = sum(n for _, _, n in each)
    out = np.array([(own[path] / total, above[up] / total, 0, count[path]) for path, up, _ in each], np.float32)
    out[:, 2] = np.arange(len(blocks)) / len(blocks)
    out[:, 3] = np.log1p(out[:, 3]) / 5
    return out


class Inputs:
    """Block -> vector: the tag path and the words as signed hashes, figures of the text, and its part of the page."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words = Hashed()

    def tokens(self, tokens: Iterable[str], v: np.ndarray) -> np.ndarray:
        for token in tokens:
            i, s = _slot(token, PATH)
            v[i] += s
        return v

    def path(self, path: Place | tuple[str, ...]) -> np.ndarray:
        """The different tokens of a path as signed hashes, and its last word by itself."""
        if isinstance(path, tuple):
            if path not in self.paths:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                self.paths[path] = self.tokens({*path, *(t.rpartition(".")[2] for t in path if "." in t), f"^{path[-1] if path else ''}"}, np.zeros(PATH, np.float32))
            return self.paths[path]
        if path.vector is None:  # from the nearest ancestor that has its vector
            line, at = [], path
            while at is not None and at.vector is None:
                line.append(at)
                at = at.parent
            base = at.vector[0] if at is not None else np.zeros(PATH, np.float32)
            for p in reversed(line):
                base = self.tokens(p.fresh, base.copy()) if p.fresh else base
            path.vector = (base, self.tokens([f"^{path.words[-1] if path.words else ''}"], base.copy()))
        return path.vector[1]

    def of(self, blocks: list[Block], around: np.ndarray | None = None) -> np.ndarray:
        """Vectors of a page's blocks, or of some of them with their ``context``."""
        out = np.zeros((len(blocks), WIDTH), np.float32)
        out[:, PATH + WORDS + STATS :] = context(blocks) if around is None else around
        for row, (path, text) in zip(out, blocks, strict=True):
            row[:PATH] = self.path(path)
            words = text.lower().split(" ")
            seen = np.bincount(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)), minlength=2 * WORDS)
            row[PATH : PATH + WORDS] = (seen[1::2] - seen[::2]) / np.sqrt(len(words))
            n = len(text)
            row[PATH + WORDS : PATH + WORDS + STATS] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, n / len(words) / 10, text.count(".") / len(words), text.count(",") / len(words), text[-1] in ".!?", text[0].isupper(), sum(map(text.count, "|©»›")) > 0)
        return out


def start(seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p = {"out": g.standard_normal(2 * HIDDEN) * 0.2, "out_b": np.zeros(())}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        p |= {f"w{d}": g.standard_normal((WIDTH, 4 * HIDDEN)) * 0.15, f"u{d}": g.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2, f"c{d}": bias}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_lstm(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, backward: bool, keep: bool = False):
    """Hidden states (T, B, HIDDEN) for input gates (T, B, 4 * HIDDEN): in, forget, out, new. Padding leaves the state."""
    steps, batch, _ = gates.shape
    h = c = np.zeros((batch, HIDDEN), np.float32)
    out, cache = np.empty((steps, batch, HIDDEN), np.float32), [None] * steps
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        a = gates[t] + h @ u
        s, n = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        fresh = f * c + i * n
        k = np.tanh(fresh)
        if keep:
            cache[t] = (h, c, i, f, o, n, k)
        h, c = np.where(mask[t], o * k, h), np.where(mask[t], fresh, c)
        out[t] = h
    return (out, cache) if keep else out


def logits(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(T, B) for inputs (T, B, WIDTH)."""
    states = np.concatenate([run_lstm(x @ p[f"w{d}"] + p[f"c{d}"], p[f"u{d}"], mask, d == "b") for d in "fb"], axis=2)
    return states @ p["out"] + p["out_b"]


def long_logits(p: dict[str, np.ndarray], inputs: Inputs, blocks: list[Block], part: int = 4096) -> np.ndarray:
    """The logits of one page's blocks, of which only ``part`` at a time are held as vectors; the states go on between."""
    z, around = np.full(len(blocks), p["out_b"], np.float32), context(blocks)
    starts = range(0, len(blocks), part)
    half = np.repeat(np.float32([0.5, 1]), [3 * HIDDEN, HIDDEN])  # a sigmoid is a tanh of half its input
    for d, weights in (("f", p["out"][:HIDDEN]), ("b", p["out"][HIDDEN:])):
        h = c = np.zeros(HIDDEN, np.float32)
        u = p[f"u{d}"] * half
        for at in starts if d == "f" else reversed(starts):
            gates = (inputs.of(blocks[at : at + part], around[at : at + part]) @ p[f"w{d}"] + p[f"c{d}"]) * half
            states = np.empty((len(gates), HIDDEN), np.float32)
            for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
                k = np.tanh(gates[t] + h @ u)
                s = 0.5 * k[: 3 * HIDDEN] + 0.5
                c = s[HIDDEN : 2 * HIDDEN] * c + s[:HIDDEN] * k[3 * HIDDEN :]
                h = states[t] = s[2 * HIDDEN :] * np.tanh(c)
            z[at : at + part] += states @ weights
    return z


def gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over all blocks of a batch of pages."""
    runs = {d: run_lstm(x @ p[f"w{d}"] + p[f"c{d}"], p[f"u{d}"], mask, d == "b", True) for d in "fb"}
    states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    d_logit = ((_sigmoid(states @ p["out"] + p["out_b"]) - y) * mask[..., 0] / mask.sum()).astype(np.float32)
    g = {"out": np.einsum("tbi,tb->i", states, d_logit), "out_b": d_logit.sum()}
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        u, cache, steps = p[f"u{d}"], runs[d][1], len(x)
        dh = dc = np.zeros(x.shape[1:2] + (HIDDEN,), np.float32)
        ga, gu = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
        for t in range(steps) if d == "b" else range(steps - 1, -1, -1):
            h, c, i, f, o, n, k = cache[t]
            dh = dh + d_logit[t][:, None] * p["out"][part]
            live_h, live_c = np.where(mask[t], dh, 0), np.where(mask[t], dc, 0)
            d_fresh = live_c + live_h * o * (1 - k * k)
            a = np.concatenate([d_fresh * n * i * (1 - i), d_fresh * c * f * (1 - f), live_h * k * o * (1 - o), d_fresh * i * (1 - n * n)], axis=1)
            ga[t] = a
            gu += h.T @ a
            dh = np.where(mask[t], 0, dh) + a @ u.T
            dc = np.where(mask[t], d_fresh * f, dc)
        g |= {f"u{d}": gu, f"c{d}": ga.sum(axis=(0, 1)), f"w{d}": np.einsum("tbi,tbj->ij", x, ga)}
    return g


def padded(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, inputs))
    x, mask = np.zeros((longest, len(inputs), WIDTH), np.float32), np.zeros((longest, len(inputs), 1), bool)
    for b, v in enumerate(inputs):
        x[: len(v), b], mask[: len(v), b] = v, True
    return x, mask


# How pages are laid out: names of the parts that hold an article, and of those around it.
ARTICLE_NAMES = "article main content post entry story body text page primary article-body post-content entry-content main-content".split()
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
AROUND = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav tabs pagination pager toc links".split(),
    "header": "header masthead topbar banner branding site-header logo".split(),
    "footer": "footer site-footer copyright colophon bottom legal".split(),
    "aside": "sidebar aside widget related recommended popular tags secondary rail".split(),
    "notice": "cookie cookies consent notice alert popup modal gdpr newsletter subscribe paywall message".split(),
    "ad": "ad ads advert advertisement sponsored promo promoted banner-ad sponsor".split(),
    "form": "form login search signup contact-form register".split(),
    "comment": "comments comment discussion reply replies respond comment-list user-comment reader-comments".split(),
}
BOILERPLATE = frozenset(w for names in AROUND.values() for n in names for w in n.split("-")) | frozenset(SEMANTIC) | {"head", "title", "button", "menu", "dialog", "figcaption-ad"}


def weak_label(block: Block) -> int | None:
    """1 inside an article or main element, 0 inside a part that by its name is something else, None if neither tells."""
    path = list(block.path)
    tags = [t.rpartition(".")[2] if "." in t else t for t in path]
    inside = max((i for i, t in enumerate(path) if t in ("article", "main")), default=-1)
    other = max((i for i, t in enumerate(tags) if t in BOILERPLATE and path[i] not in ("main", "article")), default=-1)
    if other > inside or (inside < 0 and other >= 0):
        return 0
    return 1 if inside >= 0 else None


# Words that names of comment threads are composed of, and short texts that stand around articles.
THREAD = ("post user reader visitor guest item entry disqus fb the all latest".split(), "comments comment thread reply replies response responses feedback discussion talkback opinions reviews respond guestbook".split())
SMALL = ("Home", "About", "Contact", "News", "Log in", "Sign up", "Share", "Read more", "Next", "Previous", "Top", "Menu", "Search", "Reply", "Like", "Report", "All rights reserved", "Privacy policy", "Terms of use", "© 2021 The Company", "3 comments", "2 days ago", "Leave a reply", "Load more", "Follow us", "Advertisement", "More stories", "Tags")
SYLLABLES = "ka lo mi ter wra bo xi qu zen fla dor pi sto ne ru gal vek ty".split()


def drawn_page(g: np.random.Generator, main: list[str], rest: list[str]) -> tuple[list[Block], list[int]]:
    """Blocks of a page with drawn names and nesting, around given article and other texts, with their labels.

    An article holds paragraphs, headings, lists, tables of words and numbers, captions, code and definitions. A third of the
    names are made up and say nothing, so that structure, neighbours and text must decide.
    """
    pick = lambda names: names[g.integers(len(names))]
    out: list[tuple[Block, int]] = []

    def made_up() -> str:
        return "".join(pick(SYLLABLES) for _ in range(int(g.integers(1, 4)))) + (f"-{pick(SYLLABLES)}" if g.random() < 0.3 else "")

    def named(tag: str, name: str) -> tuple[str, ...]:
        if g.random() < 0.35:
            name = made_up()
        elif g.random() < 0.25:
            name = f"{made_up()}-{name}" if g.random() < 0.5 else f"{name}-{made_up()}"
        return (tag, *(f"{tag}.{w}" for w in re.split("[_-]", name)))

    def plain(tag: str, name: str) -> tuple[str, ...]:
        return (tag, *(f"{tag}.{w}" for w in re.split("[_-]", name)))

    def put(path: tuple[str, ...], text: str, label: int) -> None:
        out.append((Block(path, text), label))

    def words(texts: list[str], low: int, high: int) -> str:
        some, size = pick(texts).split(), int(g.integers(low, high))
        at = int(g.integers(max(1, len(some) - size)))
        return " ".join(some[at : at + size])

    def number() -> str:
        return pick([f"{g.integers(1, 3000)}", f"{g.integers(1, 100)}.{g.integers(0, 100)}", f"{g.integers(1, 100)} %", f"{g.integers(1, 10)},{g.integers(100, 1000)}", f"{g.integers(1990, 2030)}", "-", f"${g.integers(1, 900)}"])

    def comments(base: tuple[str, ...]) -> None:
        name = f"{pick(THREAD[0])}-{pick(THREAD[1])}" if g.random() < 0.5 else pick(AROUND["comment"] + THREAD[1])
        thread = base + (plain(pick(["div", "section", "ol", "ul", "aside"]), name) if g.random() < 0.9 else ("div",))
        each = pick([(), ("li",), ("article",), ("div",), plain("div", f"{pick(THREAD[0])}-{pick(THREAD[1])}"), plain("li", pick(THREAD[1])), plain("article", pick(THREAD[1]))])
        inner = pick([(), (), ("div",), plain("div", f"{pick(THREAD[1])}-body"), plain("div", f"{pick(THREAD[1])}-content")])
        if g.random() < 0.5:
            put(thread + pick([("h2",), ("h3",), ("p",)]), pick(["Comments", "3 comments", "Leave a reply", "Responses", "Discussion"]), 0)
        for _ in range(int(g.integers(1, 8))):
            if g.random() < 0.4:
                put(thread + each + pick([("b",), ("span",), ("h4",), ("div",), ("header",)]), words(main, 1, 3), 0)
            put(thread + each + inner + pick([("p",), ("p",), ("div",), ()]), words(main, 3, 40), 0)
            if g.random() < 0.3:
                put(thread + each + pick([("a",), ("div",), ("footer",)]), pick(["Reply", "Like", "Report", "2 days ago"]), 0)

    def around(kind: str, base: tuple[str, ...]) -> None:
        if kind == "comment":
            return comments(base)
        tag = SEMANTIC.get(kind)
        style = g.random()
        path = base + ((tag,) if tag and style < 0.4 else (pick(["ul", "div", "ul"]),) if kind == "nav" and style < 0.5 and base in (root, outer) else plain("ul", pick(AROUND[kind])) if kind == "nav" and style < 0.65 else named(pick(["div", "section", tag or "div"]), pick(AROUND[kind])))
        if g.random() < 0.25:
            path += ("div",)
        listed = path[-1].partition(".")[0] == "ul"
        for _ in range(int(g.integers(1, 7 if kind in ("nav", "aside") else 3))):
            short = kind in ("nav", "form", "header")
            text = pick(SMALL) if g.random() < (0.4 if short else 0.15) else words(rest, 1 if short else 3, 4 if short else 40)
            leaf = ("li",) if listed else ("ul", "li") if kind in ("nav", "aside") and g.random() < 0.7 else ("p",) if g.random() < 0.6 else (pick(["h2", "h3", "div", "button", "td"]),) if g.random() < 0.5 else ()
            put(path + leaf, text, 0)

    def piece(base: tuple[str, ...], paragraph: tuple[str, ...]) -> None:
        kind = g.random()
        if kind < 0.58:
            put(base + paragraph, pick(main) if g.random() < 0.9 else words(main, 2, 12), 1)
        elif kind < 0.65:
            put(base + (pick(["h2", "h3", "h4"]),), words(main, 1, 9), 1)
        elif kind < 0.78:
            list_, long = pick([("ul",), ("ul",), ("ol",)]), g.random() < 0.5
            for _ in range(int(g.integers(2, 7))):
                put(base + list_ + ("li",), pick(main) if long else words(main, 1, 6), 1)
        elif kind < 0.87:
            table, numeric = pick([("table", "tr"), ("table", "tbody", "tr"), ("div", "table", "tr"), plain("table", "data") + ("tr",)]), g.random()
            if g.random() < 0.3:
                put(base + table[: table.index("tr")] + ("caption",), words(main, 2, 8), 1)
            rows, columns = int(g.integers(2, 7)), int(g.integers(2, 5))
            for r in range(rows):
                for c in range(columns):
                    text = number() if r and g.random() < (numeric if c else 0.3) else words(main, 1, 4)
                    put(base + table + ("th" if r == 0 and rows > 2 else "td",), text, 1)
        elif kind < 0.91:
            put(base + ("figure", "figcaption"), words(main, 2, 20), 1)
        elif kind < 0.94:
            put(base + pick([("blockquote",), ("blockquote", "p")]), pick(main), 1)
        elif kind < 0.97:
            put(base + pick([("pre",), ("pre", "code"), ("div", "pre")]), pick([words(main, 2, 15), f"x = {number()} + f({number()})", f"{words(main, 1, 3)} = {number()};"]), 1)
        else:
            for _ in range(int(g.integers(1, 4))):
                put(base + ("dl", "dt"), words(main, 1, 4), 1)
                put(base + ("dl", "dd"), words(main, 2, 20), 1)

    outer = ()
    root = ("html", "body") + (plain("div", pick(["wrapper", "page", "container", "site", "root", "layout"])) if g.random() < 0.4 else named("div", "page") if g.random() < 0.2 else ())
    put(("html", "head", "title"), pick(main)[:60], 0)
    for kind in [k for k in ("notice", "nav", "header", "nav", "ad", "form", "aside") if g.random() < 0.4]:
        around(kind, root)
    style = g.random()
    outer = root + (("main",) if style < 0.3 else named("div", pick(ARTICLE_NAMES)) if style < 0.45 else plain("div", made_up()) if style < 0.6 else ())
    style = g.random()
    base = outer + (("article",) if style < 0.35 else () if style < 0.5 and outer != root else named(pick(["div", "section", "article"]), pick(ARTICLE_NAMES)) if style < 0.92 else ("div",))
    if base != root and g.random() < 0.15:  # tabs or a menu before the text
        around("nav", pick([outer, base]) if outer != root else base)
    paragraph = pick([("p",)] * 6 + [("div",), (), named("div", "text")])
    for k in range(int(g.integers(1, 13))):
        if k == 0 and g.random() < 0.7:
            put(base + (pick(["h1", "h1", "h2"]),), pick(main)[:70], 1)
        piece(base if g.random() < 0.9 else base + ("section",), paragraph)
        if g.random() < 0.14:
            around(pick(["ad", "aside", "notice", "form", "form"]), base)
    for kind in ("comment", "nav", "aside", "form"):  # behind the text, in the same element or the one around it
        if g.random() < (0.45 if kind == "comment" else 0.12):
            around(kind, pick([base, outer]))
    for kind in [k for k in ("comment", "aside", "form", "ad", "nav", "footer") if g.random() < (0.25 if k == "comment" else 0.45)]:
        around(kind, root)
    return [b for b, _ in out if b.text], [y for b, y in out if b.text]


def fit(pages: pd.DataFrame, drawn: int = 3500, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 9, texts_each: int = 6, most_blocks: int = 5000, most_steps: int = 200) -> bytes:
    """The network of a bounded sample of pages (html), as bytes.

    Pages carry no labels. Those of the sample are labelled where elements and names tell what a part is; and their
    article and other texts are laid out anew in ``drawn`` pages with names and nesting drawn at random, of which every
    label is known. Without any article text the network learns from drawn pages with fixed words. Each page gives up to
    ``texts_each`` texts of either kind to draw from, out of its first ``most_blocks`` blocks, and at most its first
    ``most_steps`` blocks are learnt from; these bound training alone.
    """
    g, inputs = np.random.default_rng(seed), Inputs()
    rows: list[tuple[np.ndarray, list[int]]] = []
    main, rest = [], []
    for page in pages["html"]:
        found = blocks_of(page)[:most_blocks]
        labels = [weak_label(b) for b in found]
        main += [b.text for b, y in zip(found, labels, strict=True) if y == 1][:texts_each]
        rest += [b.text for b, y in zip(found, labels, strict=True) if y == 0][:texts_each]
        if found and None not in labels:
            rows.append((inputs.of(found), labels))
    main = main or ["This is some text of an article that tells a story in a few words.", "Then it goes on, with one more sentence."]
    rest = rest or ["Home", "About us", "Read more in our terms of use and privacy notice"]
    for _ in range(drawn):
        found, labels = drawn_page(g, main, rest)
        rows.append((inputs.of(found), labels))
    p = start(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    rows = [(x[:most_steps], y[:most_steps]) for x, y in rows]
    total = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = g.permutation(len(rows))
        order = order[np.argsort([len(rows[k][1]) + g.random() * 8 for k in order], kind="stable")]
        parts = [order[at : at + batch] for at in range(0, len(order), batch)]
        for k in g.permutation(len(parts)):
            some = [rows[r] for r in parts[k]]
            x, mask = padded([r[0] for r in some])
            y = np.zeros(mask.shape[:2], np.float32)
            for b, (_, labels) in enumerate(some):
                y[: len(labels), b] = labels
            step += 1
            for name, d in gradients(p, x, mask, y).items():
                first[name] = 0.9 * first[name] + 0.1 * d
                second[name] = 0.99 * second[name] + 0.01 * d * d
                p[name] = (p[name] - rate * (1 - step / (total + 1)) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return pickle.dumps(p)


def extraction_model(pages: DataFrame, most_pages: int = 400, most_chars: int = 500_000) -> bytes:
    """Trained in one task from at most ``most_pages`` pages of at most ``most_chars``, picked by the hash of their ids."""
    picked = sample_by_id(pages.where(F.length("html") <= most_chars), "page_id", "html", most_pages)

    return train_in_task(picked.withColumnRenamed("page_id", "doc_id"), fit)


def texts_of(p: dict[str, np.ndarray], inputs: Inputs, pages: Iterable[str | None], least: float = 0.0) -> list[str]:
    """The main text of each page: its blocks with a logit over ``least``, one a line."""
    found = [blocks_of(page) for page in pages]
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    out = [""] * len(found)
    at = 0
    while at < len(order):  # pages of like length together, up to some 20,000 blocks
        end = at + 1
        if len(found[order[at]]) > 20_000:
            z = long_logits(p, inputs, found[order[at]])
            out[order[at]] = "\n".join(block.text for block, v in zip(found[order[at]], z, strict=True) if v > least)
            at = end
            continue
        while end < len(order) and end - at < 256 and (end - at + 1) * len(found[order[end]]) <= 20_000:
            end += 1
        x, mask = padded([inputs.of(found[i]) for i in order[at:end]])
        z = logits(p, x, mask)
        for b, i in enumerate(order[at:end]):
            out[i] = "\n".join(block.text for block, v in zip(found[i], z[:, b], strict=False) if v > least)
        at = end
    return out


def extract(pages: DataFrame, model: bytes) -> DataFrame:
    """Adds text and n_chars to every row of ``pages`` (html).

    Every block of the whole page is read and labelled; text joins those labelled as article by one newline, and n_chars
    counts its code points. A null, empty or blank page has an empty text. Rows are kept as they are; other columns stay
    and those of the two names are replaced.
    """
    base = pages.drop("text", "n_chars")
    held = shared(pages.sparkSession, model)
    state: list = []

    @F.pandas_udf("string")
    def main_text(html_: pd.Series) -> pd.Series:
        if not state:
            state.extend((pickle.loads(held()), Inputs()))
        out: list[str] = []
        for at in range(0, len(html_), 256):
            out += texts_of(state[0], state[1], html_[at : at + 256])
        return pd.Series(out, dtype=object)

    return base.withColumn("text", main_text("html")).withColumn("n_chars", F.length("text").cast("long"))
