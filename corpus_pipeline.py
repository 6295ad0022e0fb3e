"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as
Parquet in the shared folder and reads again for the next one. All but the last return the
columns of documents; others are dropped. An empty table gives an empty one. No stage has a SQL form as a whole, so ORACLE_SQL is None; a test
holds the result against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm import decontam, dedup, langid, packing, secrets
from fluxweave.runtime import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells with confidence; rejected and undetermined ones go.

    A text that is null, empty or without a letter is undetermined. Rows are judged each for
    itself, so repeated ones stay together; without any labelled document all go.
    """
    model = langid.fit(docs.where(~langid.in_fold("doc_id", 4, 2)))
    return langid.predict(docs.select(COLUMNS), model).where("not rejected").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Texts without words are in no group. Of rows with equal doc_id and text one stays; rows
    without a doc_id are the last of their group.
    """
    return dedup.deduplicate(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item. Texts without words stay; each row is judged for itself."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.without_contaminated(docs.select(COLUMNS), items)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by their kind; n_chars follows the text, null for a null one."""
    clean = secrets.redacted(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences; a null or empty text is its end id, each row has its own pieces."""
    # Workers of earlier stages are still there, so this one remembers fewer pieces.
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_words=100_000)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
