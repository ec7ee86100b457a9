"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import pii, secret_scan
from pairwright.llm.common import held_out, table
from pairwright.llm.decontaminate import contaminated_words, items_digest
from pairwright.llm.embedding_dedup import embedding_groups
from pairwright.llm.html_extract import extract, extraction_model
from pairwright.llm.language import identify, language_model, not_learnt
from pairwright.llm.mixing import mix
from pairwright.llm.quality import quality_model, score_quality
from pairwright.llm.resampling import drawn, importance_scores
from pairwright.llm.simhash import simhash_groups
from pairwright.llm.toxicity import score_toxicity, toxicity_model
from pairwright.llm.url_filter import Rule, judge_urls
from pairwright.llm.vector_codes import vector_codes

URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url, by the four rules."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, from its whole html."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, extraction_model(pages)).select("page_id", "url", "text", "n_chars")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed formats and random strings."""
    return secret_scan.digest(secret_scan.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors of equal labels with a cosine of 0.98 or more."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark item's window of ten words."""
    out = contaminated_words(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", items_digest(F.col("item_ids")).alias("items_sha256"), "contaminated")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: fixed formats and disclosing terms."""
    return pii.digest(pii.private_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learnt from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document, within four bits."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document against the benchmark, and the rank of the quarter that is drawn."""
    scored = importance_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn(scored.select("doc_id", "n_features", "weight", "score"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, by 16 codebooks of 64 entries after two rounds."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from the texts of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = identify(docs.select("doc_id", "text"), language_model(docs))
    return said.select("doc_id", not_learnt("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_secret_scan": op4_secret_scan,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_language_id": op13_language_id,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op11_importance_resampling": r"""
WITH RECURSIVE shift8(b, k, c) AS (SELECT b::UBIGINT, 0, b::UBIGINT FROM range(256) AS t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM shift8 WHERE k < 8),
crc_table AS (SELECT b, c FROM shift8 WHERE k = 8),
docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
aims AS (SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
doc_features AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM docs),
aim_features AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM aims),
different AS (SELECT DISTINCT f FROM (SELECT f FROM doc_features UNION ALL SELECT f FROM aim_features)),
coded AS (SELECT f, hex(f) AS x, length(hex(f)) // 2 AS n FROM different),
-- what a byte adds to the checksum where k bytes follow it, and what the constant at the start adds
places(k, b, c) AS (SELECT 0, b, c FROM crc_table UNION ALL SELECT k + 1, p.b, xor(t.c, p.c >> 8) FROM places p JOIN crc_table t ON t.b = p.c & 255 WHERE k < (SELECT max(n) FROM coded)),
begun(k, c) AS (SELECT 0, 4294967295::UBIGINT UNION ALL SELECT k + 1, xor(t.c, p.c >> 8) FROM begun p JOIN crc_table t ON t.b = p.c & 255 WHERE k < (SELECT max(n) FROM coded)),
bytes AS (SELECT f, n, n - 1 - i AS k, ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT AS b FROM coded, unnest(range(n)) AS t(i)),
sums AS (SELECT f, n, bit_xor(p.c) AS c FROM bytes JOIN places p USING (k, b) GROUP BY f, n),
buckets AS (SELECT f, xor(xor(s.c, g.c), 4294967295::UBIGINT) % 10000 AS bucket FROM sums s JOIN begun g ON g.k = s.n),
held AS (SELECT doc_id, bucket FROM doc_features JOIN buckets USING (f)),
s AS (SELECT bucket, count(*) AS s FROM held GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim_features JOIN buckets USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM held JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM placed) THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)""",
    "op12_vector_codes": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, list_slice(x, p * (len(x) // 16) + 1, (p + 1) * (len(x) // 16)) AS x FROM v, unnest(range(16)) AS t(p)),
first_ AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64),
book0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN first_ USING (vec_id)),
book1_near AS MATERIALIZED (SELECT vec_id, part, x, least_.d AS d, least_.e AS e FROM (SELECT vec_id, p.part, any_value(p.x) AS x,
  min({'d': list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), 'e': c.entry}) AS least_ FROM parts p JOIN book0 c USING (part) GROUP BY vec_id, p.part)),
book1_mean AS (SELECT part, e AS entry, list(m ORDER BY i) AS x FROM (SELECT part, e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM book1_near, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY part, e, i) GROUP BY part, e),
book1 AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM book0 c LEFT JOIN book1_mean m USING (part, entry)),
book2_near AS MATERIALIZED (SELECT vec_id, part, x, least_.d AS d, least_.e AS e FROM (SELECT vec_id, p.part, any_value(p.x) AS x,
  min({'d': list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), 'e': c.entry}) AS least_ FROM parts p JOIN book1 c USING (part) GROUP BY vec_id, p.part)),
book2_mean AS (SELECT part, e AS entry, list(m ORDER BY i) AS x FROM (SELECT part, e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM book2_near, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY part, e, i) GROUP BY part, e),
book2 AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM book1 c LEFT JOIN book2_mean m USING (part, entry)),
told AS (SELECT vec_id, part, x, least_.d AS d, least_.e AS e FROM (SELECT vec_id, p.part, any_value(p.x) AS x,
  min({'d': list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), 'e': c.entry}) AS least_ FROM parts p JOIN book2 c USING (part) GROUP BY vec_id, p.part)),
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM told GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  sha256((SELECT string_agg(array_to_string(x, ','), ',' ORDER BY part, entry) FROM book2)) AS codebooks_sha256 FROM coded JOIN v USING (vec_id)""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings e LEFT JOIN least ON least.node = vec_id LEFT JOIN degree ON degree.node = vec_id""",
    "op1_url_filter": r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path,
  (SELECT arg_max(u.host || u.path, length(u.host || u.path)) FROM rules u WHERE (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)) AS rule,
  coalesce((SELECT arg_max(u.verdict, length(u.host || u.path)) FROM rules u WHERE (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)), 'allow') AS verdict
FROM parts p""",
    "op6_decontamination": r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS g FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
doc_words AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (SELECT k, i, n, list_slice(w, i, i + n - 1) AS g FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT k, i, n, item_id FROM grams JOIN windows USING (g)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY k),
items AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (k) LEFT JOIN items USING (k)""",
}
