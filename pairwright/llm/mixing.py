"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
import json
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import cut, unused


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets_of(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Each source's target: its weight's part of ``share`` of all sizes, at most ``most`` times its own size.

    Sources are weighed in the order of their code points, null last, the weights repeating. What a source can't take is
    shared among the others by weight, until none is above its limit.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def route(capacity: list[int], members: list[list[int]], quota: list[int], costs: tuple[int, ...] = (0, 1)) -> list[list[int]]:
    """Tokens that go from each membership pattern to each of its sources, at least cost.

    A pattern gives its capacity once at ``costs[0]`` a token, again at ``costs[1]`` and so on; rising costs make use
    convex, so repetition starts only where fresh tokens are out. Successive shortest paths with potentials. A source
    that only its own pattern feeds needs no search, so the work is that of the overlapping part.
    """
    flow = [[0] * len(m) for m in members]
    need = list(quota)
    feeders: dict[int, int] = {}
    for m in members:
        for s in m:
            feeders[s] = feeders.get(s, 0) + 1
    used = [0] * len(capacity)
    for p, m in enumerate(members):
        if len(m) == 1 and feeders[m[0]] == 1:
            flow[p][0] = used[p] = min(need[m[0]], capacity[p] * len(costs))
            need[m[0]] -= used[p]
    overlapping = [p for p, m in enumerate(members) if not (len(m) == 1 and feeders[m[0]] == 1)]
    if not overlapping:
        return flow
    # nodes: 0 start, 1 end, then patterns, then sources
    graph: list[list[list[int]]] = [[] for _ in range(2 + len(capacity) + len(quota))]

    def arc(a: int, b: int, cap: int, cost: int) -> None:
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    where = {}
    for p in overlapping:
        for c in costs:
            arc(0, 2 + p, capacity[p], c)
        for i, s in enumerate(members[p]):
            where[p, i] = (2 + p, len(graph[2 + p]))
            arc(2 + p, 2 + len(capacity) + s, capacity[p] * len(costs), 0)
    for s, n in enumerate(need):
        arc(2 + len(capacity) + s, 1, n, 0)
    height = [0] * len(graph)
    while True:
        far, back, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, cap, cost, _) in enumerate(graph[a]):
                if cap and (n := d + cost + height[a] - height[b]) < far.get(b, 1 << 62):
                    far[b], back[b] = n, (a, k)
                    heapq.heappush(heap, (n, b))
        if 1 not in far:
            break
        height = [h + far.get(i, far[1]) for i, h in enumerate(height)]
        path, at = [], 1
        while at:
            path.append(back[at])
            at = back[at][0]
        push = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            b, _, _, r = graph[a][k]
            graph[a][k][1] -= push
            graph[b][r][1] += push
    for (p, i), (a, k) in where.items():
        b, _, _, r = graph[a][k]
        flow[p][i] = graph[b][r][1]
    return flow


def _crossing(parts: DataFrame, rest: DataFrame, cell: str) -> DataFrame:
    """Per pattern, the cell in which the running sum of n reaches ``rest``, and what is left when it begins."""
    before = Window.partitionBy("p").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(rest), "p")
    return begins.where((F.col("begin") <= F.col("rest")) & (F.col("begin") + F.col("n") > F.col("rest"))).select("p", cell, (F.col("rest") - F.col("begin")).alias("rest"))


def _nth_rows(marked: DataFrame, pattern: str, place: str, row: str, bound: DataFrame) -> DataFrame:
    """(p, row): for each pattern of ``bound`` (p, at, fits) the row number up to which there are ``fits`` rows at place ``at``.

    Rows are numbered in the order of their partitions, so those are counted first, and only one's rows are then sorted.
    """
    rows = marked.select(F.col(pattern).alias("p"), F.col(place).alias("at"), F.col(row).alias("row")).join(F.broadcast(bound.select("p", "at", "fits")), ["p", "at"])
    parts = cut(rows.groupBy("p", "fits", F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n")))
    before = Window.partitionBy("p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = parts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("begin") < F.col("fits")) & (F.col("begin") + F.col("n") >= F.col("fits")))
    crossing = cut(crossing.select("p", "part", (F.col("fits") - F.col("begin")).alias("nth")))
    inside = rows.withColumn("part", F.shiftright("row", 33)).join(F.broadcast(crossing), ["p", "part"])
    return inside.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("row"))).where("k = nth").select("p", "row")


def mix(docs: DataFrame, members: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17, most_patterns: int = 100_000) -> DataFrame:
    """Adds size, source_size, target and taken to every row of ``docs`` (text and ``members``).

    ``members`` names a column with a source, or with an array of those a document belongs to. Documents are aggregated
    by membership pattern; a min-cost flow routes each pattern's tokens to its sources' targets; then every pattern
    takes whole rounds of its documents and, for what is left, documents in the order of a seeded hash up to the amount,
    to within half a document. So taken is a multiple of size, at most ``most`` times it, and reruns agree; of rows equal
    in doc_id and text, which can't be told apart, as many are taken as come nearest to the amount. For
    overlapping sources, source_size and target are sums over the document's sources.

    Null and empty texts have size 0 and nothing taken; a null member is a source of its own; an empty array belongs to
    no source and is never taken; an empty table gives no rows. Columns of the new names are replaced, all others stay. Only sums of at most ``most_patterns`` patterns reach the driver;
    more raise an error. The place where the amount is reached is found in 512 hash ranges and then in 512 parts of one
    of them, so no task holds a whole source.
    """
    new = ["size", "source_size", "target", "taken"]
    base = docs.drop(*new)
    is_array = dict(base.dtypes)[members].startswith("array")
    names = F.array_distinct(F.transform(F.col(members), lambda x: x.cast("string"))) if is_array else F.array(F.col(members).cast("string"))
    pattern = F.to_json(F.array_sort(F.transform(F.coalesce(names, F.array(F.lit(None).cast("string"))), lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("null")))))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.col(c) for c in ("doc_id", "text") if c in base.columns)), 1)  # 0 to 2^63
    pattern_, place_, row_ = (unused(docs, x) for x in ("p", "h", "row"))
    marked = base.withColumns({pattern_: pattern, "size": word_count(F.col("text")), place_: place, row_: F.monotonically_increasing_id()})
    slim = cut(marked.select(F.col(pattern_).alias("p"), F.col(place_).alias("h"), "size"))
    coarse = cut(slim.groupBy("p", F.shiftright("h", 54).alias("r")).agg(F.sum("size").alias("n")))
    rows = coarse.groupBy("p").agg(F.sum("n").alias("n")).limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError(f"over {most_patterns} membership patterns")
    totals = sorted((r[0], int(r[1])) for r in rows)
    named = [[None if x == "null" else x[1:] for x in json.loads(p)] for p, _ in totals]
    sizes: dict[str | None, int] = {}
    for of, (_, n) in zip(named, totals, strict=True):
        for s in of:
            sizes[s] = sizes.get(s, 0) + n
    target = targets_of(sizes, weights, share, most)
    number = {s: i for i, s in enumerate(sizes)}
    flow = route([n for _, n in totals], [[number[s] for s in of] for of in named], [round(target[s]) for s in sizes], tuple(range(most)))
    plan = [(p, sum(sizes[s] for s in of), float(sum(target[s] for s in of)), sum(f) // n if n else 0, sum(f) % n if n else 0) for (p, n), of, f in zip(totals, named, flow, strict=True)]
    # bounded by most_patterns, so these may be broadcast
    planned = docs.sparkSession.createDataFrame(plan, "p string, source_size long, target double, rounds long, rest long")
    first = cut(_crossing(coarse, planned.select("p", "rest"), "r"))
    fine = slim.withColumn("r", F.shiftright("h", 54)).join(F.broadcast(first.select("p", "r")), ["p", "r"]).groupBy("p", F.shiftright("h", 45).alias("c")).agg(F.sum("size").alias("n"))
    second = cut(_crossing(fine, first.select("p", "rest"), "c"))
    tail = slim.withColumn("c", F.shiftright("h", 45)).join(F.broadcast(second), ["p", "c"])
    # rows of one place are copies of one row; of them as many are taken as come nearest to the amount
    places = tail.groupBy("p", "h", "rest").agg(F.max("size").alias("size"), F.sum("size").alias("n"), F.count("*").alias("copies"))
    upto = Window.partitionBy("p").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.when(F.col("size") == 0, F.col("copies")).otherwise(F.floor((F.col("rest") - F.coalesce(F.sum("n").over(upto), F.lit(0))) / F.col("size") + 0.5))
    places = places.withColumn("fits", F.greatest(F.lit(0), F.least(fits, F.col("copies"))))
    some = (F.col("fits") > 0) & (F.col("fits") < F.col("copies"))
    last = cut(places.groupBy("p").agg(F.max(F.when(F.col("fits") == F.col("copies"), F.col("h"))).alias("last"), F.max(F.when(some, F.struct("h", "fits"))).alias("part")))
    # where no document of the crossing part is taken, all before that part are
    bound = planned.join(second.select("p", F.shiftleft("c", 45).alias("from")), "p", "left").join(last, "p", "left")
    bound = cut(bound.select("p", "source_size", "target", "rounds", F.coalesce("last", F.col("from") - 1).alias("last"), F.col("part.h").alias("at"), F.col("part.fits").alias("fits")))
    upto_row = _nth_rows(marked, pattern_, place_, row_, bound.where("at is not null")) if bound.where("at is not null").limit(1).count() else None
    if upto_row is not None:
        bound = cut(bound.join(upto_row, "p", "left"))
    b = unused(docs, "b")
    whole = F.col(place_) <= F.col(f"{b}.last")
    extra = F.coalesce(whole | ((F.col(place_) == F.col(f"{b}.at")) & (F.col(row_) <= F.col(f"{b}.row"))) if upto_row is not None else whole, F.lit(False)).cast("int")
    joined = marked.join(F.broadcast(bound.select(F.col("p").alias(pattern_), F.struct(*(c for c in bound.columns if c != "p")).alias(b))), pattern_)
    return joined.select(*base.columns, "size", F.col(f"{b}.source_size").alias("source_size"), F.col(f"{b}.target").alias("target"), (F.col("size") * (F.col(f"{b}.rounds") + extra)).alias("taken"))
