"""A pluggable judge: prompts, bounded retries, and checked verdicts."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.functions.text import json_object
from pairwright.sources.records import settled

VERDICT = "has_hallucinations boolean, hallucination_details string, has_awkward_language boolean, awkward_language_details string, overall_quality_score double, fit_assessment string, recommendations array<string>, red_flags array<string>"


def judge_prompt(rubric: str) -> Column:
    """Rubric, rule results and both documents of a row of ``metrics``."""
    context = F.to_json(F.struct(F.col("fit").alias("computed_fit_label"), F.bround("overlap", 6).alias("skills_overlap"), *policy.FLAGS))
    return F.concat(F.lit(rubric + "\n\nWhat the rules found:\n"), context, F.lit("\n\nJob:\n"), F.to_json("job_description"), F.lit("\n\nCandidate:\n"), F.to_json("resume"), F.lit("\n"))


def may_retry(error: Exception) -> bool:
    """True for rate limits, server errors, timeouts and lost connections."""
    code = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    if isinstance(code, int):
        if code == 429 or 500 <= code <= 599:
            return True
    words = f"{type(error).__name__} {error}".lower()
    return any(w in words for w in ("ratelimit", "timeout", "connection", "rate limit", "too many requests"))


def with_retries(call: Callable[[str], str], most: int = 3, first_delay: float = 1.0, longest_delay: float = 20.0, jitter: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call`` with a bounded number of tries, the wait doubling each time."""
    if most < 1:
        raise ValueError("at least one try is needed")

    def run(prompt: str) -> str:
        for n in range(most):
            try:
                return call(prompt)
            except Exception as e:
                if n + 1 == most or not may_retry(e):
                    raise
                wait = min(longest_delay, getattr(e, "retry_after", None) or first_delay * 2**n)
                sleep(max(0.0, wait * (1 + jitter * random.uniform(-1, 1))))
        raise AssertionError

    return run


def share_of(budget: int | None, part: int, parts: int) -> float:
    """How many calls one of so many tasks may make of a budget that all of them share."""
    return float("inf") if budget is None else budget // parts + (part < budget % parts)


def ask_each(prompts: DataFrame, call: Callable[[str], str], key: str = "trace_id", parallel: int | None = None, in_flight: int = 8, budget: int | None = None) -> DataFrame:
    """(key, answer, error) for (key, prompt): each task has up to ``in_flight`` calls at a time; a failure is the row's error.

    ``call`` is used by several threads of a task. Rows keep their keys and order. With a ``budget``, which needs ``parallel``,
    each of so many tasks has its share of it; a row beyond that has an error and isn't asked, as has one without a prompt.
    The caller must write the result before it reads it more than once, or calls are repeated (``ask_once`` does so).
    """
    if budget is not None and not parallel:
        raise ValueError("a budget is shared by a number of tasks: set parallel")

    def one(prompt: str | None, left: bool) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, "no prompt"
        if not left:
            return None, "the call budget is spent"
        try:
            return call(prompt), None
        except Exception as e:
            return None, str(e) or type(e).__name__

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get()
        most, asked = share_of(budget, at.partitionId() if at else 0, parallel or 1), 0
        with ThreadPoolExecutor(in_flight) as pool:
            for f in frames:
                count = f["prompt"].notna().cumsum() + asked
                said = list(pool.map(one, f["prompt"], count <= most))
                asked += int(f["prompt"].notna().sum())
                yield pd.DataFrame({"key": f["key"], "answer": pd.Series([x for x, _ in said], dtype=object), "error": pd.Series([e for _, e in said], dtype=object)})

    rows = prompts.select(F.col(key).cast("string").alias("key"), "prompt")
    rows = rows.repartition(parallel) if parallel else rows
    return rows.mapInPandas(run, "key string, answer string, error string").withColumnRenamed("key", key)


def ask_once(prompts: DataFrame, call: Callable[[str], str], store: str, key: str = "trace_id", parallel: int = 32, **limits: int | None) -> DataFrame:
    """(key, answer, error) for (key, prompt); no prompt that has an answer in the folder ``store`` is asked, and equal ones are
    asked once.

    Prompts are known by their SHA-256. What a run is told is added to the store under a new name, errors left out, so that the
    next run asks for those again. A row without a prompt has an error.
    """
    spark = prompts.sparkSession
    rows = prompts.select(F.col(key).cast("string").alias(key), F.sha2("prompt", 256).alias("hash"), "prompt")
    different = rows.where("prompt is not null").groupBy("hash").agg(F.min("prompt").alias("prompt"))
    if known := kept_answers(spark, store):
        different = different.join(known, "hash", "left_anti")
    told = settled(ask_each(different.select("hash", "prompt"), call, "hash", parallel, **limits))
    told.where("error is null").select("hash", "answer").write.parquet(f"{store}/{uuid.uuid4().hex}")
    every = kept_answers(spark, store).select("hash", "answer", F.lit(None).cast("string").alias("error")).unionByName(told.where("error is not null"))
    out = rows.select(key, "hash").join(every, "hash", "left")
    return out.select(key, "answer", F.when(F.col("hash").isNull(), "no prompt").otherwise(F.col("error")).alias("error"))


def kept_answers(spark: SparkSession, store: str) -> DataFrame | None:
    """(hash, answer) of all runs in the store; None if there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    return spark.read.schema("hash string, answer string").option("recursiveFileLookup", True).parquet(store).groupBy("hash").agg(F.min("answer").alias("answer"))


def verdicts(answers: DataFrame) -> DataFrame:
    """Judge rows of (trace_id, answer, error): an answer that isn't an object of the eight fields becomes judge_error."""
    body = json_object(F.col("answer"))
    parsed = F.from_json(body, VERDICT)
    score = parsed["overall_quality_score"]
    # malformed: a field missing, null or of another type
    whole = F.forall(F.array(*(parsed[c].isNotNull() for c in ("has_hallucinations", "hallucination_details", "has_awkward_language", "awkward_language_details", "overall_quality_score", "fit_assessment", "recommendations", "red_flags"))), lambda x: x)
    error = F.coalesce("error", F.when(body.isNull(), "no JSON object in the answer"), F.when(~F.coalesce(whole & score.between(0, 1), F.lit(False)), "the answer is not a verdict"))
    rows = answers.select("trace_id", parsed.alias("v"), error.alias("judge_error"))
    blank = F.col("judge_error").isNotNull()
    keep = lambda c, empty: F.when(blank, empty).otherwise(F.col(f"v.{c}")).alias(c)
    lists = F.array().cast("array<string>")
    return rows.select(
        "trace_id", keep("has_hallucinations", None), keep("hallucination_details", F.lit("")), keep("has_awkward_language", None), keep("awkward_language_details", F.lit("")),
        keep("overall_quality_score", None), keep("fit_assessment", F.lit("")), keep("recommendations", lists), keep("red_flags", lists), "judge_error",
    )
