"""The policy's final set: as many pairs of every fit level, and at least so many pairs of each of enough jobs, at once."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.operators.policy_splits import place


class Flow:
    """A flow from jobs to levels: job j sends ``flow[j][l]`` <= ``room[j][l]`` units to level l, which takes ``quota[l]``.

    Levels are few, so a path is found among them: from one level to another that some job can serve instead.
    """

    def __init__(self, quota: list[int]):
        self.quota, self.used = list(quota), [0] * len(quota)
        self.room: dict[int, list[int]] = {}
        self.flow: dict[int, list[int]] = {}

    def copy(self) -> Flow:
        out = Flow(self.quota)
        out.used, out.room, out.flow = list(self.used), dict(self.room), {j: list(f) for j, f in self.flow.items()}
        return out

    def send(self, job: int) -> bool:
        """One unit more from ``job``, along a shortest path; False if no level can be reached that has room."""
        levels, came = range(len(self.quota)), {}
        queue = deque()
        for level in levels:
            if self.flow[job][level] < self.room[job][level]:
                came[level] = (None, job)
                queue.append(level)
        while queue:
            level = queue.popleft()
            if self.used[level] < self.quota[level]:
                self.used[level] += 1
                while level is not None:  # back along the path: each job on it serves this level instead of the one before
                    before, by = came[level]
                    self.flow[by][level] += 1
                    if before is not None:
                        self.flow[by][before] -= 1
                    level = before
                return True
            for by, sent in self.flow.items():
                if sent[level]:
                    for other in levels:
                        if other not in came and sent[other] < self.room[by][other]:
                            came[other] = (level, by)
                            queue.append(other)
        return False

    def add(self, job: int, room: list[int], units: int) -> bool:
        """Adds a job that sends ``units``, or leaves all as it was and tells that it can't."""
        kept = self.used[:], {j: list(f) for j, f in self.flow.items()}
        self.room[job], self.flow[job] = room, [0] * len(room)
        if all(self.send(job) for _ in range(units)):
            return True
        self.used, self.flow = kept
        del self.room[job]
        return False


def full_jobs(rooms: list[list[int]], quota: list[int], each: int, most_steps: int = 5000) -> list[int]:
    """Indexes of jobs, as many as possible, that can all send ``each`` units to levels of these quotas, in order of
    preference.

    Jobs are added in their order as long as a flow exists. Where that falls short of the bound that the quotas and the rooms set,
    it is tried again with single jobs left out or taken first, up to ``most_steps`` times; the best found is returned.
    A job that can't be added once can't be added later, nor can any other of equal room.
    """

    def greedy(order: list[int]) -> list[int]:
        f, hopeless = Flow(quota), set()
        for j in order:
            if sum(f.used) + each > sum(quota):
                break
            if tuple(rooms[j]) not in hopeless and not f.add(j, rooms[j], each):
                hopeless.add(tuple(rooms[j]))
        return sorted(f.flow)

    able = [j for j, r in enumerate(rooms) if sum(r) >= each]
    whole = Flow(quota)
    for level in range(len(quota)):  # what all jobs together could send, whole or not
        whole.used[level] = min(quota[level], sum(rooms[j][level] for j in able))
    bound = min(len(able), sum(whole.used) // each)
    best, steps = greedy(able), 0
    tried = {tuple(best)}
    queue = deque([best])
    while queue and len(best) < bound and steps < most_steps:
        now = queue.popleft()
        # a job of each kind that is in, put last; a job of each kind that is out, put first
        ins = list({tuple(rooms[j]): j for j in reversed(now)}.values())
        outs = list({tuple(rooms[j]): j for j in reversed(able) if j not in set(now)}.values())
        for drop in [None, *ins]:
            for first in [None, *outs]:
                if len(best) >= bound or steps >= most_steps or (drop is None and first is None):
                    break
                steps += 1
                rest = [j for j in now if j != drop]
                got = greedy([*([first] if first is not None else []), *rest, *(j for j in able if j not in set(now) and j != first), *([drop] if drop is not None else [])])
                if tuple(got) not in tried and len(got) >= len(now):
                    tried.add(tuple(got))
                    queue.append(got)
                    if len(got) > len(best):
                        best = got
                        queue.appendleft(queue.pop())
    return best


def shares(rooms: dict[str, list[int]], quota: list[int], each: int) -> dict[str, list[int]]:
    """How many pairs of each level each of the chosen jobs gives: ``each`` first, and then what the quotas still lack."""
    f = Flow(quota)
    for j, room in rooms.items():
        f.add(j, room, min(each, sum(room)))
    going = True
    while going and sum(f.used) < sum(quota):
        going = False
        for j in rooms:  # in turns, so that no job gives all
            if j in f.flow:
                going |= f.send(j)
    return f.flow


def spread_pick(rows: DataFrame, group: str, per_level: dict[str, int], each: int = 5, key: str = "trace_id", level: str = "fit_level", seed: int = 42) -> DataFrame:
    """Rows of ``per_level[x]`` of every level x, out of groups of which each gives at least ``each`` rows.

    Groups are as many as that allows: with five levels of 50 and five rows each, 50 groups. What can't be met is left short:
    see ``spread_report``. Groups and rows are preferred by the lowest seeded hash. Rows of other levels, or without
    group, count for nothing. Adds pick, the row's place among its group's rows of its level.

    Groups are reduced to how many rows of each level they have, up to ``each``: the kinds of groups are few whatever the
    number of groups, and of each kind only as many groups as could be picked are named. The flow runs over those.
    """
    levels, quota = list(per_level), list(per_level.values())
    most = max(1, sum(quota) // each)
    # the rows' own columns lie in one, so that names can't clash
    named = rows.select(F.struct(*rows.columns).alias("row"), F.col(group).cast("string").alias("g"), F.col(level).alias("x"), place(seed, key).alias("h"), F.col(key).alias("k"))
    live = named.where(F.col("x").isin(*levels) & F.col("g").isNotNull())
    counts = [F.count_if(F.col("x") == x).alias(f"n{k}") for k, x in enumerate(levels)]
    sized = live.groupBy("g").agg(*counts)
    kind = F.array(*(F.least(F.col(f"n{k}"), F.lit(each)).cast("int") for k in range(len(levels))))
    able = sized.select("g", kind.alias("kind"), place(seed, "g").alias("h")).where(F.aggregate("kind", F.lit(0), lambda a, b: a + b) >= each)
    first = able.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("h", "g"))).where(F.col("r") <= most)
    known = sorted((r["h"], r["g"], r["kind"]) for r in first.collect())  # at most (each + 1) ** levels * most rows
    chosen = [known[j][1] for j in full_jobs([list(k[2]) for k in known], quota, each)]
    names = rows.sparkSession.createDataFrame([(g,) for g in chosen], "g string")
    few = live.join(F.broadcast(names), "g", "left_semi").groupBy("g").agg(*counts).collect()
    rooms = {r["g"]: [min(r[f"n{k}"], q) for k, q in enumerate(quota)] for r in few}
    taken = [(g, levels[k], n) for g, f in shares({g: rooms[g] for g in chosen}, quota, each).items() for k, n in enumerate(f) if n]
    wanted = rows.sparkSession.createDataFrame(taken, "g string, x string, take int")
    w = Window.partitionBy("g", "x").orderBy("h", "k")
    # the literal bound lets Spark drop rows before it shuffles a large group
    ranked = live.join(F.broadcast(wanted), ["g", "x"]).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= max(quota)).where(F.col("pick") <= F.col("take"))
    return ranked.select(*(F.col("row")[c].alias(c) for c in rows.columns if c != "pick"), "pick")


def spread_report(picked: DataFrame, group: str, per_level: dict[str, int], n_groups: int = 50, each: int = 5, level: str = "fit_level") -> DataFrame:
    """One row: rows, groups, the least rows of a group, the least of a level, what is short of each condition, and passed."""
    of_groups = picked.groupBy(group).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_jobs"), F.min("c").alias("least_per_job"))
    short = sum((F.greatest(F.lit(q) - F.count_if(F.col(level) == x), F.lit(0)) for x, q in per_level.items()), F.lit(0))
    least = F.least(*(F.count_if(F.col(level) == x) for x in per_level)) if len(per_level) > 1 else F.count_if(F.col(level) == next(iter(per_level)))
    out = of_groups.crossJoin(picked.agg(least.alias("least_per_level"), short.cast("long").alias("short_of_levels")))  # one row each
    out = out.withColumn("short_of_jobs", F.greatest(F.lit(n_groups).cast("long") - F.col("n_jobs"), F.lit(0).cast("long")))
    return out.withColumn("passed", (F.col("short_of_levels") == 0) & (F.col("short_of_jobs") == 0) & F.coalesce(F.col("least_per_job") >= each, F.lit(False)))
