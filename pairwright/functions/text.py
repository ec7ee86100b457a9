"""Language checks on whole texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions import policy


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


def count_terms(text: Column, terms: tuple[str, ...] = policy.BUZZWORDS) -> Column:
    """Non-overlapping occurrences of each term in the lower-cased text, summed."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms)).cast("int")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9']+"), F.lit(0))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` evaluated once however often ``f`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def repeated_windows(words: Column, window: int = policy.REPEAT_WINDOW, times: int = policy.REPEAT_COUNT) -> Column:
    """True if a run of ``window`` tokens occurs at least ``times`` times; equal runs are neighbours when sorted.

    Three equal runs repeat at least one token more than a run has (``window + times - 2`` in general), so a count of different
    tokens settles texts with fewer. Hashes of the runs are compared first; the runs themselves are only looked at where hashes
    repeat. Tokens are taken by place, as each slice of an array costs a pass over all of it.
    """

    def repeats(w: Column) -> Column:
        return F.size(w) - F.size(F.array_distinct(w))

    def runs(w: Column, run: Callable[..., Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: run(*(F.get(w, i + k) for k in range(window))))

    def again(runs: Column) -> Column:
        return once(F.sort_array(runs), lambda r: F.exists(F.zip_with(r, F.slice(r, times, F.size(r)), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))

    def hashed(h: Column) -> Column:
        return F.when(repeats(h) < window + times - 2, False).otherwise(once(runs(h, F.xxhash64), lambda r: F.when(repeats(r) < times - 1, False).otherwise(again(r))))

    def seen(w: Column) -> Column:
        return F.when(once(F.transform(w, lambda x: F.xxhash64(x)), hashed), again(runs(w, lambda *x: F.concat_ws(" ", *x)))).otherwise(False)

    return once(words, lambda w: F.when(F.size(w) < window + times - 1, False).otherwise(seen(w)))


def repeated_nearby(words: Column, window: int = policy.LOCAL_WINDOW, times: int = policy.LOCAL_COUNT, chars: int = policy.LOCAL_CHARS) -> Column:
    """True if a token of at least ``chars`` letters occurs ``times`` times within ``window`` tokens."""

    def seen(w: Column) -> Column:
        equal = lambda i, x: reduce(lambda a, b: a + b, (F.when(F.get(w, i + k) == x, 1).otherwise(0) for k in range(1, window)))
        return F.exists(F.sequence(F.lit(0), F.size(w) - 1), lambda i: once(F.get(w, i), lambda x: (F.length(x) >= chars) & (equal(i, x) >= times - 1)))

    return once(words, lambda w: F.when(F.size(w) < window, False).otherwise(seen(w)))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer, from its first to its last brace; null if there is none."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))
    return F.when(F.try_parse_json(body).isNotNull(), body)
