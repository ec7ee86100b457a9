"""Spans of regular expressions in whole texts, by built-in functions only. Offsets count code points.

A text may hold very many matches, so nothing here grows by one element a match or looks from the front of a text for
each: arrays are worked on in runs of about the root of their size, and then over the runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
MARKED = "array<struct<start:int,end:int,mark:string>>"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it inside its own functions of arrays."""
    return F.get(F.transform(F.array(value), f), 0)


def _runs(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(run, index of the run's first element)`` for each run of the array; runs have the root of its size, or one more."""
    size = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), size), lambda at: at < F.size(values))
    return bound(F.struct(values.alias("v"), size.alias("c"), starts.alias("s")), lambda x: F.transform(x["s"], lambda at: f(F.slice(x["v"], at + 1, x["c"]), at)))


def running(values: Column, step: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """The running result of ``step`` (a sum or a maximum; ``start`` leaves it as it is) over an array of int."""
    none = F.array().cast("array<int>")

    def along(run: Column) -> Column:
        return F.aggregate(run, none, lambda done, x: F.array_append(done, step(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(start)), x)))

    def over(inner: Column) -> Column:
        ends = F.aggregate(inner, F.array(F.lit(start)), lambda done, run: F.array_append(done, step(F.element_at(done, -1), F.element_at(run, -1))))
        return F.flatten(F.zip_with(inner, F.slice(ends, F.lit(1), F.size(inner)), lambda run, before: F.transform(run, lambda x: step(before, x))))

    return bound(values, lambda v: F.when(F.size(v) == 0, none).otherwise(bound(_runs(v, lambda run, _: along(run)), over)))


def find_spans(text: Column, pattern: str | Column, guard: Column) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` (never empty ones) as (start, end, value).

    Splitting at the matches gives the pieces between them, so running lengths give the offsets. ``guard`` is a cheap
    condition without which a text can't hold a match.
    """

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(found["pieces"], F.lit(1), F.size(found["matches"])), found["matches"], lambda p, m: F.length(p) + F.length(m))
        ends = running(steps, lambda a, b: a + b)
        return F.zip_with(found["matches"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    matches = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    found = F.when(guard, F.struct(F.split(text, pattern, -1).alias("pieces"), matches.alias("matches")))
    return F.coalesce(bound(found, placed), F.from_json(F.lit("[]"), SPAN))


def joined(spans: list[tuple[str, Column]]) -> Column:
    """All spans as kind:start:end by start, then by kind in the order listed, comma-joined."""

    def ranked_as(k: int, s: Column) -> Column:
        return F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end")))

    ranked = [ranked_as(k, s) for k, (_, s) in enumerate(spans)]
    names = F.array(*(F.lit(name) for name, _ in spans))
    return F.array_join(F.transform(F.array_sort(F.concat(*ranked)), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def merged(spans: list[tuple[str, Column]]) -> Column:
    """The union of (mark, spans) as disjoint (start, end, mark), sorted; the first of overlapping spans gives the mark."""

    def marked(mark: str, s: Column) -> Column:
        return F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(mark).alias("mark")))

    def union(sorted_: Column) -> Column:
        return bound(F.struct(sorted_.alias("s"), running(F.transform(sorted_, lambda x: x["end"]), lambda a, b: F.greatest(a, b)).alias("reach")), heads)

    def heads(x: Column) -> Column:
        # a span begins a part of the union where it begins behind all spans before it
        first = F.filter(F.sequence(F.lit(0), F.size(x["s"]) - 1), lambda i: (i == 0) | (F.get(x["s"], i)["start"] >= F.get(x["reach"], i - 1)))
        both = F.zip_with(first, F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(x["s"]))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(both, lambda p: F.struct(F.get(x["s"], p["a"])["start"].alias("start"), F.get(x["reach"], p["b"] - 1).alias("end"), F.get(x["s"], p["a"])["mark"].alias("mark")))

    every = F.array_sort(F.concat(*(marked(m, s) for m, s in spans)))
    return bound(every, lambda v: F.when(F.size(v) == 0, F.from_json(F.lit("[]"), MARKED)).otherwise(bound(v, union)))


def replaced(text: Column, spans: Column, fill: Callable[[Column], Column] | None = None) -> Column:
    """The text with each of the disjoint, sorted spans (start, end, mark) replaced by its mark, or by ``fill(span)``."""
    put = fill or (lambda x: x["mark"])

    def cut(run: Column, begin: Column, piece: Column) -> Column:
        """A run of spans in the piece of text that begins at ``begin`` and ends with the run."""
        begins = F.concat(F.array(begin), F.transform(run, lambda x: x["end"]))
        return F.array_join(F.zip_with(F.slice(begins, F.lit(1), F.size(run)), run, lambda b, x: F.concat(F.substring(piece, b - begin + 1, x["start"] - b), put(x))), "")

    def over(x: Column) -> Column:
        runs, text_ = x["runs"], x["text"]
        begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: F.element_at(r, -1)["end"]))
        pairs = F.zip_with(F.slice(begins, F.lit(1), F.size(runs)), runs, lambda b, r: F.struct(b.alias("b"), r.alias("r")))
        done = F.transform(pairs, lambda p: bound(F.struct(p["b"].alias("b"), p["r"].alias("r"), F.substring(text_, p["b"] + 1, F.element_at(p["r"], -1)["end"] - p["b"]).alias("t")), lambda q: cut(q["r"], q["b"], q["t"])))
        return F.concat(F.array_join(done, ""), F.substring(text_, F.element_at(begins, -1) + 1, F.length(text_)))

    return bound(F.struct(text.alias("text"), spans.alias("s")), lambda x: F.when(F.size(x["s"]) == 0, x["text"]).otherwise(bound(F.struct(x["text"].alias("text"), _runs(x["s"], lambda run, _: run).alias("runs")), over)))


def blanked(text: Column, spans: list[Column]) -> Column:
    """The text with every character inside the spans turned into a blank, so that offsets stay."""
    parts = merged([("", s) for s in spans])
    return replaced(text, parts, lambda x: F.repeat(F.lit(" "), x["end"] - x["start"]))
