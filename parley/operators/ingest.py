"""Parsed snapshots to the rows of the five capture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id, stamp_ms
from ..schemas import TABLES


def _rows(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


def ingest_ready(captures: DataFrame) -> DataFrame:
    """Captures whose metadata are all there and which were parsed; the others are for quarantine."""
    needed = ("conversation_id", "source_url", "fetched_at", "file_path", "transcript_path")
    ok = F.col("parsed.error").isNull() & F.col("parsed").isNotNull()
    for c in needed:
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return captures.withColumn("ready", ok)


def ingest(captures: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """Frames of the capture tables.

    ``captures``: conversation_id, source_url, fetched_at, parsed, and file_path, sha256, byte_size, media_type of the
    raw file and, with the prefix ``transcript_`` (path, sha256, byte_size), of the transcript file.
    """
    now = stamp_ms(F.current_timestamp()) if now is None else now
    base = ingest_ready(captures).filter("ready").withColumn("created_at", now)
    base = base.withColumn("source_artifact_id", stable_id("art", F.col("file_path")))
    base = base.withColumn("transcript_artifact_id", stable_id("art", F.col("transcript_path")))
    base = base.withColumn("transcript_id", stable_id("tr", F.col("conversation_id"), F.col("transcript_artifact_id")))

    def artifact(kind: str, id_: str, path: str, sha: str, size: str, media: Column) -> DataFrame:
        return base.select(
            F.col(id_).alias("artifact_id"),
            "conversation_id",
            "source_url",
            F.lit(kind).alias("artifact_kind"),
            F.col(path).alias("file_path"),
            media.alias("media_type"),
            F.col(sha).alias("sha256"),
            F.col(size).alias("byte_size"),
            F.col("fetched_at").alias("captured_at"),
            "created_at",
        )

    raw = artifact("source_snapshot", "source_artifact_id", "file_path", "sha256", "byte_size", F.col("media_type"))
    parsed = artifact("parsed_transcript", "transcript_artifact_id", "transcript_path", "transcript_sha256", "transcript_byte_size", F.lit("application/json"))
    transcripts = base.select(
        "transcript_id",
        "conversation_id",
        F.col("parsed.title").alias("title"),
        "source_artifact_id",
        "transcript_artifact_id",
        F.col("parsed.method").alias("parser_method"),
        "fetched_at",
        F.size("parsed.messages").alias("message_count"),
        F.size("parsed.warnings").alias("warning_count"),
        "created_at",
    )
    messages = base.select("transcript_id", "conversation_id", "created_at", F.explode("parsed.messages").alias("m"))
    blocks = messages.select("transcript_id", F.col("m.index").alias("message_index"), "created_at", F.posexplode("m.blocks").alias("block_index", "b"))
    warnings = base.select("transcript_id", "created_at", F.posexplode("parsed.warnings").alias("warning_index", "w"))
    flat = messages.select("transcript_id", "conversation_id", F.col("m.index").alias("message_index"), "m.role", "m.text", "m.timestamp", "m.provenance_json", "created_at")
    frames = {
        "raw_artifacts": raw.unionByName(parsed),
        "transcripts": transcripts,
        "transcript_messages": flat,
        "transcript_message_blocks": blocks.select(
            "transcript_id", "message_index", "block_index", F.col("b.type").alias("block_type"), "b.text", "b.language", "b.metadata_json", "created_at"
        ),
        "transcript_warnings": warnings.select("transcript_id", "warning_index", "w.code", "w.message", "w.message_index", "created_at"),
    }
    return {name: _rows(df, name) for name, df in frames.items()}


def transcript_json(captures: DataFrame) -> Column:
    """The transcript document of a capture: source, conversation, messages and warnings."""
    p = F.col("parsed")
    source = F.struct(
        F.col("source_url").alias("url"),
        F.lit("claude_shared_snapshot").alias("capture_method"),
        p["method"].alias("parser_method"),
        F.col("fetched_at").alias("fetched_at"),
        F.col("sha256").alias("raw_sha256"),
    )
    conversation = F.struct(F.col("conversation_id").alias("id"), p["title"].alias("title"))
    return F.to_json(F.struct(source.alias("source"), conversation.alias("conversation"), p["messages"].alias("messages"), p["warnings"].alias("warnings")))
