"""Documents of the ledger as files: raw snapshots, transcripts and model outputs.

Each is one line-safe text row per document under its key's folder; Spark's committer moves finished files into place, so a
reader never sees half a file. Raw snapshots are written before parsing, so what can't be parsed is still there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stamp, sniff_format, strip
from ..operators.ingest import transcript_json


def write_raw(captures: DataFrame, root: str) -> None:
    """``raw/format=json|html/``: conversation_id, stamp and the text as it came."""
    rows = captures.select("conversation_id", file_stamp(F.col("fetched_at")).alias("stamp"), "text", sniff_format(F.col("text")).alias("format"))
    rows.write.mode("append").partitionBy("format").parquet(f"{root}/raw")


def write_transcripts(parsed: DataFrame, root: str) -> None:
    """``transcripts/``: one JSON document per line, those with an error left out."""
    rows = parsed.filter("parsed.error is null").select(transcript_json(parsed).alias("value"))
    rows.write.mode("append").text(f"{root}/transcripts")


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """What ``write_transcripts`` wrote, typed; documents without the needed fields are quarantined in ``ready``."""
    from ..schemas import PARSED

    kinds = {f.name: f.dataType.simpleString() for f in PARSED.fields}
    schema = (
        "source struct<url:string,capture_method:string,parser_method:string,fetched_at:string,raw_sha256:string>,"
        f" conversation struct<id:string,title:string>, messages {kinds['messages']}, warnings {kinds['warnings']}"
    )
    rows = spark.read.schema(schema).json(f"{root}/transcripts")
    needed = (F.col("conversation.id"), F.col("source.url"), F.col("source.fetched_at"), F.col("source.parser_method"))
    ready = F.lit(True)
    for c in needed:
        ready = ready & (F.coalesce(c, F.lit("")) != "")
    return rows.withColumn("ready", ready)


def write_outputs(outputs: DataFrame, root: str) -> None:
    """``extractions/``: run_id, file_path and the stripped output of each run that gave JSON."""
    rows = outputs.select("run_id", "file_path", F.concat(strip(F.col("contents")), F.lit("\n")).alias("contents"))
    rows.write.mode("append").parquet(f"{root}/extractions")
