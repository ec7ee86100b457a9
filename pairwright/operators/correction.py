"""Correction rounds: prompts, the loop, and its report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.reports import last_per


#: What is asked for, before the errors and after the record.
TASK = "The record below doesn't fit its schema. Repair it."
ANSWER = "Answer with the repaired record alone, as a JSON object. Change what the errors name and leave the rest as it is."


def correction_prompt(record_type: Column, errors: Column, raw: Column, attempt: int, most: int, task: str = TASK, answer: str = ANSWER) -> Column:
    """What a model is asked for one invalid record: its errors, numbered, and the record, between two texts of the caller's."""
    lines = F.transform(errors, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". loc="), e["loc"], F.lit(" | type="), e["type"], F.lit(" | category="), e["category"], F.lit(" | message="), e["msg"]))
    listed = F.when(F.size(errors) > 0, F.array_join(lines, "\n")).otherwise("not known")
    return F.concat(F.lit(f"{task}\nTable: "), record_type, F.lit(f"\nAttempt {attempt} of at most {most}\nErrors:\n"), listed, F.lit("\nRecord:\n"), raw, F.lit(f"\n{answer}\n"))


def correction_rounds(invalid: DataFrame, ask: Callable[[DataFrame], DataFrame], validate: Callable[[DataFrame], DataFrame], folder: str, most: int = 3) -> DataFrame:
    """Attempts (record, attempt, succeeded, error_categories, raw_record) of up to ``most`` rounds.

    ``invalid``: record, record_type, raw_record, errors. ``ask`` turns (record, prompt) into (record, answer);
    ``validate`` turns (record, record_type, raw_record) into (record, errors), with an empty list for a valid record.
    Each round is written under ``folder`` before it is read, so no answer is asked for twice; only failures go on.
    """
    spark, done = invalid.sparkSession, []
    left = invalid.select("record", "record_type", "raw_record", "errors")
    for k in range(1, most + 1):
        prompts = left.select("record", correction_prompt(F.col("record_type"), F.col("errors"), F.col("raw_record"), k, most).alias("prompt"))
        answers = ask(prompts).join(left.select("record", "record_type"), "record")
        tried = answers.select("record", "record_type", F.col("answer").alias("raw_record"))
        tried.write.parquet(f"{folder}/answers_{k}")
        tried = spark.read.parquet(f"{folder}/answers_{k}")
        judged = tried.join(validate(tried).select("record", "errors"), "record").select("record", F.lit(k).alias("attempt"), "record_type", "raw_record", "errors", (F.size("errors") == 0).alias("succeeded"))
        judged.write.parquet(f"{folder}/round_{k}")
        judged = spark.read.parquet(f"{folder}/round_{k}")
        done.append(judged)
        left = judged.where("not succeeded").select("record", "record_type", "raw_record", "errors")
        if left.limit(1).count() == 0:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("error_categories", F.array_sort(F.array_distinct(F.transform("errors", lambda e: e["category"])))).drop("errors")


def outcomes(attempts: DataFrame) -> DataFrame:
    """Per record: attempts used, whether the last succeeded, and its error categories."""
    last = F.max_by(F.struct("succeeded", "error_categories"), F.col("attempt"))
    return attempts.groupBy("record").agg(F.count("*").alias("attempts"), last.alias("x")).select("record", "attempts", "x.succeeded", "x.error_categories")


def last_attempts(attempts: DataFrame) -> DataFrame:
    return last_per(attempts, ["record"], ["attempt"])


def correction_summary(done: DataFrame) -> DataFrame:
    """One row over ``outcomes``: totals, success rate, average attempts, and whether over half succeeded."""
    rate = F.coalesce(F.avg(F.col("succeeded").cast("double")), F.lit(0.0))
    return done.agg(F.count("*").alias("total_invalid_records"), F.count_if(F.col("succeeded")).alias("corrected_records"), F.count_if(~F.col("succeeded")).alias("permanently_failed_records"), rate.alias("correction_success_rate"), F.coalesce(F.avg("attempts"), F.lit(0.0)).alias("average_attempts"), (rate > 0.5).alias("meets_success_criteria"))


def attempt_histogram(done: DataFrame, most: int = 3) -> DataFrame:
    """(attempts, n) for 1 to ``most``, zeros included."""
    counts = done.groupBy("attempts").count()
    every = done.sparkSession.range(1, most + 1).select(F.col("id").alias("attempts"))
    return every.join(F.broadcast(counts), "attempts", "left").select("attempts", F.coalesce("count", F.lit(0)).alias("n"))  # as many rows as attempts


def failure_reasons(done: DataFrame) -> DataFrame:
    """(reason, n): categories of the last attempts of records that failed; unknown where there are none."""
    named = F.when(F.size("error_categories") == 0, F.array(F.lit("unknown"))).otherwise(F.array_distinct("error_categories"))
    return done.where("not succeeded").select(F.explode(named).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
