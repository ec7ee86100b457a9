"""Failure rates by window of analysis_date of the last score of each pair: a pair that is scored again moves its share."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pairwright.functions import policy

#: A row of label rows, and what a change of a pair's last one adds to the sums.
SCORE = ", ".join(["analysis_date timestamp", "computed_fit_label string", *(f"{f} boolean" for f in policy.FLAGS)])
FIELDS = ["analysis_date", "computed_fit_label", *policy.FLAGS]
#: The state is kept by bucket of pairs. A stream that goes on from a checkpoint needs the number that it began with.
BUCKETS = 4096
STORE = "spark.sql.streaming.stateStore.providerClass"


def flags_code() -> Column:
    """The flags as digits to base 3 (null, false, true), so that codes compare as the flags do, nulls lowest."""
    code = F.lit(0).cast("long")
    for f in policy.FLAGS:
        code = code * 3 + F.coalesce(F.col(f).cast("long") + 1, F.lit(0))
    return code


def true_in_code(code: Column) -> list[Column]:
    """1 for each flag that is true, else 0."""
    n = len(policy.FLAGS)
    return [(F.pmod(F.floor(code / 3 ** (n - 1 - k)), F.lit(3)) == 2).cast("long") for k in range(n)]


def rank(score: list) -> tuple:
    """What scores (date in microseconds, label, code of flags) compare by: the last of a pair's is the highest, nulls lowest."""
    return score[0], score[1] is not None, score[1] or "", score[2]


class LastScores(StatefulProcessor):
    """Keeps the last score of each pair of a bucket; gives what it adds, and takes back what the score before it had added.

    A bucket's scores are one value, read and written once a batch, as a call of the store for each pair costs milliseconds.
    A timer of event time ends a pair's state ``keep_days`` after its last score's date, so that it doesn't grow for ever; a
    score that comes later than that counts as a pair's first. A bucket has one timer, that of its pair that ends first.
    """

    def __init__(self, keep_days: float):
        self.keep = datetime.timedelta(days=keep_days) // datetime.timedelta(microseconds=1)

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("scores", "pairs string")

    def ends(self, score: list) -> int:
        return (score[0] + self.keep) // 1000

    def held(self) -> dict[str | None, list]:
        kept = self.state.get()
        return {pair: score for pair, *score in json.loads(kept[0])} if kept else {}

    def keeps(self, pairs: dict[str | None, list]) -> None:
        if pairs:
            self.state.update((json.dumps([[pair, *score] for pair, score in pairs.items()], separators=(",", ":")),))
        else:
            self.state.clear()

    def first_end(self, pairs: dict[str | None, list]) -> int | None:
        return min(map(self.ends, pairs.values()), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pairs = self.held()
        end, before = self.first_end(pairs), {}
        for f in rows:
            for pair, date, label, flags in zip(f["pair"], f["date"], f["label"], f["flags"]):
                # pandas may give another null than None
                pair, score = pair if isinstance(pair, str) else None, [int(date), label if isinstance(label, str) else None, int(flags)]
                last = pairs.get(pair)
                if last is None or rank(score) > rank(last):
                    before.setdefault(pair, last)
                    pairs[pair] = score
        if not before:
            return
        self.keeps(pairs)
        if (now := self.first_end(pairs)) != end:
            if end is not None:
                self.handle.deleteTimer(end)
            self.handle.registerTimer(now)
        changes = [(*last, -1) for last in before.values() if last is not None] + [(*pairs[pair], 1) for pair in before]
        yield pd.DataFrame(changes, columns=["date", "label", "flags", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pairs = {pair: score for pair, score in self.held().items() if self.ends(score) >= timerValues.getCurrentWatermarkInMs()}
        self.keeps(pairs)
        if pairs:
            self.handle.registerTimer(self.first_end(pairs))
        return iter(())

    def close(self) -> None:
        pass


def changes(scores: DataFrame, late: str = "2 days", keep_days: float = 90, key: str = "trace_id") -> DataFrame:
    """What each batch of a stream of label rows (trace_id, analysis_date, computed_fit_label, five flags) changes in the
    sums: rows of +1 for new last scores and of -1 for those that they replace.

    Rows over ``late`` behind the latest date seen are dropped, as are those without a date. The session's state store must
    be RocksDB's (``STORE``), which keeps the scores on disk. A batch rewrites the buckets of the pairs that it holds.
    """
    pair = F.col(key).cast("string")
    dated = scores.withWatermark("analysis_date", late).where("analysis_date is not null").select(
        F.pmod(F.xxhash64(pair), F.lit(BUCKETS)).alias("bucket"), pair.alias("pair"), "analysis_date", F.unix_micros("analysis_date").alias("date"), F.col("computed_fit_label").alias("label"), flags_code().alias("flags")
    )
    moved = dated.groupBy("bucket").transformWithStateInPandas(LastScores(keep_days), "date long, label string, flags long, n long", "Append", "EventTime")
    return moved.select(F.timestamp_micros("date").alias("analysis_date"), F.col("label").alias("computed_fit_label"), "n", *((F.col("n") * x).alias(f) for f, x in zip(policy.FLAGS, true_in_code(F.col("flags")))))


def summed(rows: DataFrame, width: str) -> DataFrame:
    """(window_start, computed_fit_label, n, flags) of changes; sums of sums are the same."""
    windowed = rows.withColumn("window_start", F.window("analysis_date", width)["start"]) if "analysis_date" in rows.columns else rows
    return windowed.groupBy("window_start", "computed_fit_label").agg(*(F.sum(c).alias(c) for c in ("n", *policy.FLAGS)))


def follow(spark: SparkSession, scores: DataFrame, out: str, checkpoint: str, width: str = "30 days", **options: object) -> None:
    """Runs the stream over all that has arrived; each batch's sums go to ``out`` under its number, so a batch that is run
    again replaces what it wrote. There is a row for each window and label that the batch changed."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        moved = changes(scores, **options)
        query = moved.writeStream.outputMode("append").foreachBatch(lambda b, n: summed(b, width).write.mode("overwrite").parquet(f"{out}/batch={n}"))
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)


def rates(sums: DataFrame) -> DataFrame:
    """(window_start, computed_fit_label, n, flags' rates) of what ``follow`` has written; windows without pairs are left out."""
    total = summed(sums, "").where("n > 0")
    return total.select("window_start", "computed_fit_label", "n", *((F.col(f) / F.col("n")).alias(f"{f}_rate") for f in policy.FLAGS))


def batch_rates(scores: DataFrame, width: str = "30 days", key: str = "trace_id") -> DataFrame:
    """The same of a table of label rows, each pair's last score alone."""
    dated = scores.where("analysis_date is not null")
    last = dated.groupBy(key).agg(F.max(F.struct(*FIELDS)).alias("s")).select("s.*")
    return rates(summed(last.select("analysis_date", "computed_fit_label", F.lit(1).cast("long").alias("n"), *(F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f) for f in policy.FLAGS)), width))
