"""Queries of this subpackage: SQL against Spark, and the pipeline's stages against their operators."""

import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pairwright.llm import queries
from pairwright.llm.common import remove
from pairwright.llm.decontaminate import contaminated_words
from pairwright.llm.simhash import simhash_groups
from pairwright.llm.toxicity import score_toxicity, toxicity_model
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(llm_spark, sf, name):
    assert_same(queries.QUERIES[name](llm_spark, sf), queries.ORACLES[name], sf)


def test_stages(llm_spark, sf, tmp_path):
    docs = llm_spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm_spark, kept[-1], sf).write.parquet(f"{tmp_path}/{k}")
        kept.append(llm_spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(k.columns == docs.columns for k in kept[:-1])
    source, calm, unique, clean, safe, mixed = kept
    model = toxicity_model(source, llm_spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in score_toxicity(source, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in source.join(calm, "doc_id", "left_anti").collect()} == toxic and toxic
    groups = simhash_groups(unique)
    assert groups.where("doc_id <> component_id").count() == 0 and 0 < unique.count() <= simhash_groups(calm).select("component_id").distinct().count()
    assert contaminated_words(clean, llm_spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    assert safe.count() == clean.count() and safe.where(F.col("text").rlike("token = \"[0-9a-f]{40}")).count() == 0
    assert mixed.where("taken = 0 or taken > 2 * size or taken <> copies * size").count() == 0


def test_a_failed_stage_leaves_nothing(llm_spark, sf, monkeypatch):
    def fails(spark, docs, sf_dir):
        raise RuntimeError("no")

    written = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda spark, docs, sf_dir: docs.limit(1)), ("second", fails)])
    monkeypatch.setattr(corpus_pipeline, "remove", lambda spark, path: (written.append(path), remove(spark, path)))
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(llm_spark, sf)
    assert len(written) == 1 and not os.path.exists(written[0].removeprefix("file:"))


def test_awkward_rows(llm_spark, sf):
    rows = [(1, None), (2, ""), (2, ""), (None, None), (None, "one two three"), (3, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "w " * 3000), (None, "a b c d e f g")]
    docs = llm_spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in corpus_pipeline.STAGES:
        docs = llm_spark.createDataFrame(stage(llm_spark, docs, sf).collect(), stage(llm_spark, docs, sf).schema)
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            assert docs.count() == len(rows)  # without a toxic word nothing goes, empty texts stay
        if name == "simhash_near_dedup":
            assert sorted((str(r.doc_id), (r.text or "")[:3]) for r in docs.collect()) == [("1", ""), ("3", "a b"), ("4", "w w"), ("None", "one")]
    assert docs.count() > 0


def test_empty(llm_spark, sf):
    docs = llm_spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm_spark, docs, sf).count() == 0
