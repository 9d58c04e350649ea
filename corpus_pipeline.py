"""The corpus pipeline: five stages, each written as Parquet and read again as the documents of the next.

Every stage takes null ids, null, empty and very long texts, repeated rows and empty tables,
and keeps columns that it doesn't know, whatever their names. Null and empty texts are
neither toxic nor copies, hold no item and no secret, and stay; rows that repeat an id and a
text are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.llm import bpe, decontamination, jaccard, secrets, toxicity
from sparkgrade.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity models reject. Without labels of both kinds none is rejected."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; the one with the smallest id. Of a group without ids one row stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a test item. An item without words is in none."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret replaced in the text; n_chars, where it is a column, follows the text. Null texts stay null."""
    clean = secrets.redact(docs, secrets.trained(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the byte-level BPE ids, and of what they decode to; null texts as empty ones. The ids and digests alone are returned."""
    return bpe.round_trip(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs


#: Model scores, similarity components and token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
