"""Landed snapshots as a stream: each micro-batch is parsed, ingested and appended once.

An extension: the ledger itself is batch. Files that are registered already are left out, and a batch's id is its epoch,
so a restart that replays an epoch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ingest, transcript_json
from ..plans.ledger import Ledger
from ..sources.snapshot import parse_snapshots


def capture_frame(files: DataFrame, fetched_at: str, host: str = "claude.ai") -> DataFrame:
    """Files (file_path, text) to captures that ``ingest`` takes; the file's name up to its first dot names the
    conversation, unless conversation_id and url are there."""
    name = F.regexp_extract("file_path", r"([^/]*?)(?:\.[^/]*)?\z", 1)
    url = F.concat(F.lit(f"https://{host}/share/"), name)
    name, url = (F.col(c) if c in files.columns else x for c, x in (("conversation_id", name), ("url", url)))
    data = F.col("text").cast("binary")
    media = F.when(F.lower("file_path").endswith(".json"), "application/json").when(F.lower("file_path").endswith(".html"), "text/html").otherwise("application/octet-stream")
    base = files.select(
        "file_path",
        "text",
        name.alias("conversation_id"),
        url.alias("source_url"),
        F.lit(fetched_at).alias("fetched_at"),
        F.sha2(data, 256).alias("sha256"),
        F.octet_length(data).cast("long").alias("byte_size"),
        media.alias("media_type"),
    )
    parsed = parse_snapshots(base)
    document = transcript_json(parsed)
    return (
        parsed.withColumn("transcript_path", F.concat(F.lit("transcripts/"), "conversation_id", F.lit("-"), F.translate(F.lit(fetched_at), "-:.", ""), F.lit(".json")))
        .withColumn("transcript_json", document)
        .withColumn("transcript_sha256", F.sha2("transcript_json", 256))
        .withColumn("transcript_byte_size", F.octet_length("transcript_json").cast("long"))
    )


def append_captures(ledger: Ledger, files: DataFrame, batch: str, fetched_at: str) -> bool:
    known = ledger.table("raw_artifacts").select("file_path")
    fresh = files.join(known, "file_path", "left_anti")
    return ledger.append(batch, ingest(capture_frame(fresh, fetched_at)))


def stream_captures(spark: SparkSession, folder: str, ledger: Ledger, checkpoint: str, fetched_at: str):
    """Start a query over the files that land in ``folder``; available ones are taken and the query ends."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    files = files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))

    def take(batch: DataFrame, epoch: int) -> None:
        append_captures(ledger, batch, f"stream-{epoch}", fetched_at)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
