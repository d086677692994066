"""A corpus pipeline of operators from alleleloom.llm: from raw documents to packed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleleloom.llm import mixing, near_copies, packing, repeats, rule_ensemble
from alleleloom.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, as they are.

    A null or empty text is scored as a text without words; a very long one is scored whole. Each row is decided by itself, so
    equal rows stay or go together, and so do ties at the bound (they stay). No rows, no result rows. Extra columns stay, whatever
    their names.
    """
    scored = rule_ensemble.score_quality(docs, table(spark, sf_dir, "labels"), whole=True)
    return scored.filter(F.col("score") >= rule_ensemble.ACCEPT).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with a similarity of 0.8 or more: that of the least doc_id.

    A null doc_id comes last, and ties in doc_id go by a fingerprint. Null and empty texts are like no other; of rows equal
    in doc_id and text one stays. Texts are compared whole. No rows, no result rows. Extra columns stay, whatever their names.
    """
    return near_copies.one_of_each(docs, percent=80)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the byte strings that one with a smaller doc_id has; those of which nothing is left go.

    A null doc_id counts as the greatest; rows with one doc_id take nothing from each other. Null and empty texts stay as
    they are. n_chars is counted anew. No rows, no result rows. Extra columns stay, whatever their names.
    """
    kept = repeats.remove_repeats(docs, whole=True)
    kept = kept.filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    now = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[now.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them: not at all, once, or twice.

    A null source is a source. Null and empty texts have no words and count for nothing in the mix. Equal rows are taken one
    by one; ties at a threshold go by the row's fingerprint. No rows, no result rows. Extra columns stay, whatever their names.
    """
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the documents by length: the rows of packing.pack, one for each document.

    Null and empty texts have length 0; the longest ones fill a batch of their own. Equal rows are packed one by one. No
    rows, no result rows. Only doc_id and text are read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near copies", near_dedup),
    ("repeated strings", repeat_dedup),
    ("mix of sources", mix),
    ("packing", pack),
]

#: A learned classifier and minwise hashing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the checkpoint folder, read again, and goes when the session ends."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
