"""Review of arriving pairs, and running failure rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.operators.labels import adjudicate, label
from pairwright.operators.validate import validate
from pairwright.sources.records import typed_pairs


def checked_pairs(lines: DataFrame) -> DataFrame:
    """Pair lines (value) with their errors; blank ones are left out."""
    return validate(lines.where(F.trim("value") != "").select(F.lit("pairs").alias("record_type"), "value"))


def reviewed(checked: DataFrame, as_of: str | None = None, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(adjudications, invalid) of validated pair lines."""
    pairs = typed_pairs(checked.where("error_count = 0").select("value"), now)
    return adjudicate(label(pairs, as_of)), checked.where("error_count > 0").select("value", "errors", "error_categories")


def review(lines: DataFrame, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(adjudications, invalid) of pair lines (value), batch or streaming; both are stateless."""
    return reviewed(checked_pairs(lines), as_of)


def review_stream(spark: SparkSession, source: str, out: str, checkpoint: str, as_of: str | None = None) -> None:
    """Reviews all lines that have arrived under ``source``; valid and invalid ones go to two tables under ``out``.

    Each batch is validated once and written under its number, so a repeated batch overwrites what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = checked_pairs(batch).persist()
        good, bad = reviewed(checked, as_of)
        good.write.mode("overwrite").parquet(f"{out}/adjudications/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/invalid/batch={number}")
        checked.unpersist()

    spark.readStream.text(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_rates(labels: DataFrame) -> DataFrame:
    """Failure rates and number of everything scored so far, by computed label."""
    return labels.groupBy("computed_fit_label").agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in policy.FLAGS))


def windowed_counts(rows: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and mean values by tumbling window.

    When streaming, in append or update mode, rows of windows that ended over ``late`` before the latest time seen are
    dropped, and so is those windows' state; complete mode would keep all of it.
    """
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), "key", "n", "mean_value")
