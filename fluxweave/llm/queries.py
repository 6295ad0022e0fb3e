"""Queries of the ten operators over the documents table, with their parameters for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm import decontam, dedup, fingerprints, langid, lmscore, packing, pii, secrets, substring, tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", langid.in_fold("doc_id", 4, 2))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_documents(spark, sf_dir).withColumn("held_out", langid.in_fold("doc_id", 10, 0)), "held_out", crossing=True)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return pii.detect(docs, pii.fit(docs))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(_documents(spark, sf_dir)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.digest(decontam.contamination(_documents(spark, sf_dir), items))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_ids,
        op2_language_id,
        op3_lm_score,
        op4_minhash_near_dedup,
        op5_fingerprints,
        op6_pii,
        op7_secret_scan,
        op8_substring_dedup,
        op9_packing,
        op10_benchmark_decontamination,
    )
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op4_minhash_near_dedup": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
 p AS (SELECT doc_id, w, unnest(generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS k FROM d),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 4], ' ')) AS h FROM p), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT doc_id, doc_id FROM d),
 r AS (SELECT doc_id AS a, doc_id AS r FROM d UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.a), c AS (SELECT a AS doc_id, min(r) AS component_id FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_substring_dedup": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
 p AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM d)),
 f AS (SELECT h, min(doc_id) AS low FROM p GROUP BY 1), g AS (SELECT DISTINCT p.doc_id, unnest(generate_series(p.k, p.k + 49)) AS j FROM p JOIN f USING (h) WHERE f.low < p.doc_id),
 x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
 y AS (SELECT x.doc_id, count(g.j) AS n_removed, string_agg(CASE WHEN g.j IS NULL THEN x.word END, ' ' ORDER BY x.j) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)""",
    "op10_benchmark_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
 bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS h FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS k FROM b WHERE len(w) > 0)),
 dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS h FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM bw))),
 m AS (SELECT dw.doc_id, dw.k, dw.n, bw.item_id FROM dw JOIN bw USING (n, h)),
 hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS j FROM m) GROUP BY 1),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
