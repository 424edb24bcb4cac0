"""The corpus pipeline: quality rules, near-dedup, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as Parquet
and read again for the next. All but the last return the columns of ``documents``, with ``n_chars`` of the text as it is.

Every stage takes null, empty and very long texts, missing and repeated ids, repeated rows, empty tables, and further
columns of any name, which pass through all stages but packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import cut, read
from parley.llm.near_dup import keep_one
from parley.llm.packing import pack
from parley.llm.quality_rules import keep_documents
from parley.llm.secret_scan import redact
from parley.llm.substring_dedup import WORDS, remove_repeats


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, among them null and empty texts, which have no words. Rows are judged one by one:
    repeated rows stay or go together, ids don't matter."""
    return keep_documents(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8. It is the row of the smallest id; of
    rows that share it, or of rows without an id where no other has one, any single one. Texts without words stay."""
    return keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages of over 50 words that occur more than once (``WORDS`` = 51), the first stays: in the smallest id, then
    place. Words are compared whole, whatever white space parts them. Rows stay, also those that have no text left; rows
    without an id come last, repeated rows in the table's order."""
    return _measured(remove_repeats(docs, length=None, words=WORDS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by one; null texts stay null, and no row goes."""
    return _measured(redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 4096 tokens; a null or empty text is its end mark, repeated rows and
    ids are packed one by one."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dup_stage),
    ("substring_dedup", repeats_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: Near-dedup, repeats and packing aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
