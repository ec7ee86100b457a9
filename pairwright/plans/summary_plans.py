"""Parts of the pipeline summary, the interpretation and the running figures that their older queries leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.plans import reporting, validation_plans
from pairwright.plans.io_plans import fresh, last_batch
from pairwright.plans.labelling import LABELS_SQL, label_rows
from pairwright.streaming import review as T

PARTS = (("validation", "v10_summary", "'success_rate'", "success_rate"), ("failure_mode", "a05_flag_summary", "flag", "rate"), ("stage_seconds", "a15_stage_durations", "stage", "seconds"))
KNOWN = reporting.QUERIES | validation_plans.QUERIES
SQL = reporting.ORACLES | validation_plans.ORACLES


def pipeline_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, name, value): validation success rate, rate of each flag, seconds of each stage."""
    rows = [KNOWN[q](spark, sf_dir).select(F.lit(part).alias("part"), F.expr(name).alias("name"), F.col(v).cast("double").alias("value")) for part, q, name, v in PARTS]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def schema_error_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note, subject, value): the most frequent schema error; no row if there is none, the first by name of equals."""
    top = KNOWN["v11_distribution"](spark, sf_dir).where(F.col("count") > 0).orderBy(F.desc("count"), "category").limit(1)
    return top.select(F.lit("top_schema_error").alias("note"), F.col("category").alias("subject"), F.col("count").cast("double").alias("value"))


def running_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts and failure rates of everything scored, from a stream over label rows."""
    folder = fresh(spark)
    rows = label_rows(spark, sf_dir).select("computed_fit_label", *policy.FLAGS)
    rows.write.parquet(f"{folder}/in")
    rates = T.running_rates(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    rates.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return last_batch(spark, f"{folder}/out")


QUERIES = {"a16_pipeline_parts": pipeline_parts, "a18_schema_error_note": schema_error_note, "t2_running_rates": running_rates}
ORACLES = {
    "a16_pipeline_parts": " UNION ALL ".join(f"SELECT '{part}' AS part, {name} AS name, {v}::DOUBLE AS value FROM ({SQL[q]})" for part, q, name, v in PARTS),
    "a18_schema_error_note": f"SELECT 'top_schema_error' AS note, category AS subject, count::DOUBLE AS value FROM ({SQL['v11_distribution']}) WHERE count > 0 ORDER BY count DESC, category LIMIT 1",
    "t2_running_rates": f"{LABELS_SQL} SELECT computed_fit_label, count(*) AS n, " + ", ".join(f"avg({f}::INT::DOUBLE) AS {f}_rate" for f in policy.FLAGS) + " FROM labels_ GROUP BY 1",
}
