"""From raw documents to a training mix: five stages, each one operator of pairwright.llm.

Stages take documents with any columns more than those of the table, and return the table's columns alone. Rows with nulls,
empty or repeated texts pass through them as the operators' docstrings say; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import secret_scan
from pairwright.llm.common import remove, shared_folder, table
from pairwright.llm.decontaminate import contaminated_words
from pairwright.llm.mixing import mix
from pairwright.llm.simhash import keep_one_near
from pairwright.llm.toxicity import score_toxicity, toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained from ``labels``, takes to be toxic go."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of close SimHash fingerprints, and of texts that share four fifths of their
    five-word shingles, which fingerprints within a few bits mostly miss."""
    return keep_one_near(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row, or all of a shorter item, go."""
    return contaminated_words(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; n_chars follows. No document goes."""
    clean = secret_scan.redacted(secret_scan.secret_spans(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often: copies and the words taken."""
    out = mix(docs).where("taken > 0")
    return out.select(*COLUMNS, "size", "source_size", "target", "taken", F.expr("cast(taken div size as int)").alias("copies"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secrets), ("mixing", mixing)]

#: Trained models and flows can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the cluster's shared folder and read again.

    A stage's folder is removed when the next one is written, so that one copy of the corpus is left: the result's, which its
    reader removes (``result.inputFiles()`` tell where it lies). Where a stage fails, all folders of the run go.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}_{name}")
            docs = spark.read.parquet(path)
            if k:
                remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    except BaseException:
        remove(spark, folder)
        raise
    return docs
