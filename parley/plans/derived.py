"""A ledger derived from the ``conversations`` table by a fixed rule, for the registered queries.

A conversation is a transcript, a turn a message of one block. Each message gives one claim of its first sentence; the
rule varies the claim's words and quote, so that every verdict occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.citation import resolve_support
from ..schemas import HEDGE_LEVELS, SPEECH_ACT_TYPES

FIRST_SENTENCE = r"(?s)\A[^.]*\.?"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("tr-"), F.col("conv_id").cast("string")).alias("transcript_id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("conversation_id"),
        F.col("turn").cast("long").alias("message_index"),
        "role",
        "text",
        F.lit(None).cast("string").alias("timestamp"),
        F.lit('{"source": "conversations"}').alias("provenance_json"),
        F.lit("2026-01-01T00:00:00.000Z").alias("created_at"),
        "conv_id",
        "turn",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    none = F.lit(None).cast("string")
    return m.select(
        "transcript_id", "message_index", F.lit(0).cast("long").alias("block_index"), F.lit("text").alias("block_type"), "text", none.alias("language"),
        F.lit("{}").alias("metadata_json"), "created_at",
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    counted = m.groupBy("transcript_id", "conversation_id").agg(F.count("*").alias("message_count"), F.max("conv_id").alias("conv_id"))
    n = F.col("conv_id").cast("string")
    return counted.select(
        "transcript_id", "conversation_id", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Conversation "), n)).alias("title"),
        F.concat(F.lit("art-raw-"), n).alias("source_artifact_id"), F.concat(F.lit("art-tr-"), n).alias("transcript_artifact_id"),
        F.lit("json_structured_data").alias("parser_method"), F.concat(F.lit("2026-01-0"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("fetched_at"),
        "message_count", F.lit(0).cast("long").alias("warning_count"), F.lit("2026-01-01T00:00:00.000Z").alias("created_at"),
    )


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as extracted, with their source text, before the support check."""
    m = messages(spark, sf_dir).withColumn("sentence", F.regexp_extract("text", FIRST_SENTENCE, 0))
    m = m.withColumn("after", F.lead("sentence").over(Window.partitionBy("conv_id").orderBy("turn")))
    way = (F.col("conv_id") + F.col("turn")) % 5
    after = F.coalesce("after", F.lit(""))
    pointed = F.col("turn") % 3 == 0
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    return m.select(
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("run_id"),
        F.concat_ws("-", F.lit("claim"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claim_id"),
        "transcript_id",
        "conversation_id",
        F.col("turn").cast("long").alias("claim_sequence"),
        F.when(way == 1, F.concat("sentence", F.lit(" "), after)).when(way == 2, F.coalesce("after", "sentence")).when(way == 4, "it is the and of").otherwise(F.col("sentence")).alias("standalone_claim_text"),
        F.col("role").alias("speaker_role"),
        F.lit(None).cast("string").alias("speaker_label"),
        pick(SPEECH_ACT_TYPES, F.col("conv_id") * 7 + F.col("turn")).alias("speech_act_type"),
        pick(HEDGE_LEVELS, F.col("turn")).alias("hedge_level"),
        F.col("message_index").alias("source_message_index"),
        F.when(pointed, F.lit(0).cast("long")).alias("source_block_index"),
        F.when(pointed, F.lit(0).cast("long")).alias("source_char_start"),
        F.when(pointed, F.length("sentence").cast("long")).alias("source_char_end"),
        F.when(way == 3, F.concat("sentence", F.lit(" zzz"))).otherwise(F.col("sentence")).alias("source_quote"),
        F.col("timestamp").alias("source_timestamp"),
        F.lit("[]").alias("concept_tags_json"),
        F.when((F.col("turn") % 4 == 3), F.concat_ws("-", F.lit("claim"), F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("supersedes_claim_id"),
        "created_at",
        F.col("text").alias("source_text"),
    )


def resolved_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_support(raw_claims(spark, sf_dir))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolved_claims(spark, sf_dir)
    return r.select(
        F.concat(F.lit("check-"), "claim_id").alias("check_id"), "claim_id", "run_id", "support_verdict", "check_method", "quote_found", "fallback_applied", "original_claim_text", "detail", "created_at"
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    n = F.substring("transcript_id", 4, 20)
    failed = n.cast("long") % 7 == 6
    none = F.lit(None).cast("string")
    return t.select(
        F.concat(F.lit("run-"), n).alias("run_id"), "transcript_id", F.lit("rule").alias("extractor_name"), F.lit("s1-009-v2").alias("prompt_version"),
        none.alias("prompt_sha256"), none.alias("model"), F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.when(failed, "Extractor raised ValueError: no output").alias("error_message"), F.col("message_count").alias("input_message_count"),
        F.when(failed, F.lit(0).cast("long")).otherwise(F.col("message_count")).alias("output_claim_count"), F.col("fetched_at").alias("started_at"),
        F.col("fetched_at").alias("completed_at"), "created_at",
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).filter("status = 'succeeded'")
    return r.select(
        "run_id", F.concat(F.lit("extractions/"), "run_id", F.lit(".json")).alias("file_path"), F.sha2("run_id", 256).alias("sha256"),
        F.octet_length("run_id").cast("long").alias("byte_size"), "created_at",
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All of them, lazy, as the read queries take them."""
    return {
        "transcripts": transcripts(spark, sf_dir),
        "transcript_messages": messages(spark, sf_dir).drop("conv_id", "turn"),
        "transcript_message_blocks": blocks(spark, sf_dir),
        "claim_ledger": resolved_claims(spark, sf_dir),
        "claim_support_checks": checks(spark, sf_dir),
        "extraction_runs": runs(spark, sf_dir),
        "extraction_outputs": outputs(spark, sf_dir),
    }
