"""Tables stored by a key, so that joins and aggregates by that key move nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.sources.records import shared_folder


def stored_by(df: DataFrame, key: str = "trace_id", buckets: int = 64, name: str | None = None) -> DataFrame:
    """The frame, written as a table of so many buckets of ``key``, each one file sorted by it, and read from there.

    Tables of as many buckets meet without a shuffle. ``buckets`` should follow the size of the largest of them: some hundred
    MB a bucket. The files lie in the shared folder; the table is dropped by whoever has given its ``name``, or stays with the session.
    """
    spark, table = df.sparkSession, name or f"stored_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, F.col(key))  # Spark's buckets are hashed as this is, so each is written by one task
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)
