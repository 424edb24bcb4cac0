"""The append-only ledger on Parquet, and its read queries.

A batch's rows are written, checked, and count from the moment that its file in the log is there. There is no update and no
delete; a batch that is already there is left alone, so replays change nothing.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BUCKETS, CHECKS, FOREIGN_KEYS, IMMUTABLE, KEYS, LOOKUP, SPEAKER_ROLES, SPEECH_ACT_TYPES, SUPPORT_VERDICTS, TABLES


class LedgerError(RuntimeError):
    """A batch or a call that the ledger doesn't take."""


class DuplicateArtifactError(LedgerError):
    """A file path is registered already."""


class QueryError(ValueError):
    """A query for what isn't there, or with a value that can't be."""


def violations(table: str, new: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rule, n): broken checks, keys and references of ``new`` rows; ``tables``: what is there, and the
    batch's other frames, under each name."""
    name = F.lit(table).alias("table_name")
    found = []
    required = [f.name for f in TABLES[table].fields if not f.nullable]
    rules = {f"not_null:{c}": F.col(c).isNull() for c in required}
    rules |= {f"check:{k}": ~F.coalesce(F.expr(sql), F.lit(True)) for k, sql in CHECKS.get(table, {}).items()}
    counts = new.agg(*[F.count_if(bad).alias(rule) for rule, bad in rules.items()])  # one pass for all row rules
    found.append(counts.select(F.explode(F.create_map(*[x for r in rules for x in (F.lit(r), F.col(f"`{r}`"))])).alias("rule", "n")).select(name, "rule", "n"))
    old = tables.get(table)
    for key in KEYS[table]:
        rule = F.lit("unique:" + ",".join(key)).alias("rule")
        twice = new.groupBy(*key).count().filter("count > 1").agg(F.count("*").alias("n"))
        found.append(twice.select(name, rule, "n"))
        if old is not None:
            again = new.select(*key).join(old.select(*key), list(key), "left_semi").agg(F.count("*").alias("n"))
            found.append(again.select(name, F.lit("exists:" + ",".join(key)).alias("rule"), "n"))
    for columns, other, theirs in FOREIGN_KEYS.get(table, []):
        target = tables.get(other)
        own = new.dropna(subset=list(columns)).select(*columns)
        if other == table:
            target = new if target is None else target.unionByName(new, allowMissingColumns=True)
        if target is not None:
            there = target.select(*[F.col(t).alias(c) for c, t in zip(columns, theirs, strict=True)])
            own = own.join(there, list(columns), "left_anti")
        found.append(own.agg(F.count("*").alias("n")).select(name, F.lit(f"references:{other}({','.join(columns)})").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found).filter("n > 0")


class Ledger:
    """Tables in a folder: ``<table>/part=<name>/bucket=<n>``, and ``_log/<version>``, one file a committed batch.

    Rows lie in the bucket of their lookup column's hash, so a lookup by it opens the files of one bucket; the others are
    pruned by path. A commit creates the log's next version, which fails if another writer was first (on file systems whose
    create is exclusive, as HDFS); the checks then run again over what that one wrote.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _file(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _version(self) -> int:
        """The log's last version."""
        fs, log = self._file("_log")
        return max((int(s.getPath().getName()) for s in fs.listStatus(log)), default=0) if fs.exists(log) else 0

    def _commit(self, version: int, batch: str, part: str) -> bool:
        """False if that version is there already."""
        fs, where = self._file(f"_log/{version:012}")
        try:
            out = fs.create(where, False)
        except Py4JJavaError:
            return False
        out.write(bytearray(json.dumps({"batch": batch, "part": part}).encode()))
        out.close()
        return True

    def _log(self) -> DataFrame:
        """(batch, part) of committed batches."""
        schema = "batch string, part string"
        return self.spark.read.schema(schema).json(f"{self.path}/_log") if self._version() else self.spark.createDataFrame([], schema)

    def create(self) -> list[str]:
        """Make the tables that aren't there yet; their names."""
        made = []
        for name, schema in TABLES.items():
            fs, where = self._file(name)
            if not fs.exists(where):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}/part=none/bucket=0")
                made.append(name)
        return made

    def table(self, name: str, **values: str | None) -> DataFrame:
        """Rows of committed batches that equal the values; one for the lookup column leaves one bucket to read."""
        schema = TABLES[name]
        parted = T.StructType([*schema.fields, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])
        try:
            rows = self.spark.read.schema(parted).parquet(f"{self.path}/{name}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], parted)
        if (value := values.get(LOOKUP[name])) is not None:
            rows = rows.filter(F.col("bucket") == zlib.crc32(value.encode()) % self.buckets)
        return _where(rows, **values).join(self._log(), "part", "left_semi").select(*schema.fieldNames())

    def tables(self) -> Tables:
        return Tables(self)

    def _drop(self, table: str, part: str) -> None:
        fs, where = self._file(f"{table}/part={part}")
        fs.delete(where, True)

    def append(self, batch: str, frames: Mapping[str, DataFrame]) -> bool:
        """Check and write a batch; False if it was there already. What is rejected leaves no files."""
        order = [t for t in TABLES if t in frames]
        part = uuid.uuid4().hex
        written: dict[str, DataFrame] = {}
        while True:
            version = self._version()
            if not self._log().filter(F.col("batch") == batch).isEmpty():
                for t in written:
                    self._drop(t, part)
                return False
            for t in order:  # written first and read back, so that what is checked is what counts
                if t not in written:
                    place = f"{self.path}/{t}/part={part}"
                    bucket = F.pmod(F.crc32(F.col(LOOKUP[t]).cast("binary")), F.lit(self.buckets)).cast("int")
                    rows = frames[t].select(*TABLES[t].fieldNames(), F.coalesce(bucket, F.lit(0)).alias("bucket"))
                    rows.repartition("bucket").sortWithinPartitions("bucket", LOOKUP[t]).write.partitionBy("bucket").parquet(place)
                    written[t] = self.spark.read.schema(TABLES[t]).parquet(place).select(*TABLES[t].fieldNames())
            there = {t: self.table(t) for t in TABLES}
            both = {t: there[t].unionByName(written[t]) if t in written else there[t] for t in TABLES}
            broken = []
            for t in order:
                broken += [tuple(r) for r in violations(t, written[t], both | {t: there[t]}).collect()]  # a few rows per table
            if broken:
                for t in written:
                    self._drop(t, part)
                kind = DuplicateArtifactError if any(r == "exists:file_path" for _, r, _ in broken) else LedgerError
                raise kind(f"batch {batch} rejected: " + "; ".join(f"{t} {r} ({n} rows)" for t, r, n in broken))
            if self._commit(version + 1, batch, part):
                return True

    def overwrite(self, table: str, *_: object) -> None:
        """Rows are never changed."""
        raise LedgerError(f"{table} is {'immutable' if table in IMMUTABLE else 'append-only'}")

    update = delete = overwrite


class Tables(Mapping):
    """The ledger's tables by name, read when asked for."""

    def __init__(self, ledger: Ledger):
        self.ledger = ledger

    def __getitem__(self, name: str) -> DataFrame:
        return self.ledger.table(name)

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def find(self, name: str, **values: str | None) -> DataFrame:
        return self.ledger.table(name, **values)


CLAIM_COLUMNS = TABLES["claim_ledger"].fieldNames()
TRANSCRIPT_COLUMNS = TABLES["transcripts"].fieldNames()


def _where(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows that equal every value that isn't None."""
    wanted = [F.col(c) == v for c, v in values.items() if v is not None]
    return df.filter(reduce(Column.__and__, wanted)) if wanted else df


def _find(t: Mapping[str, DataFrame], name: str, **values: str | None) -> DataFrame:
    return t.find(name, **values) if isinstance(t, Tables) else _where(t[name], **values)


def _member(value: str | None, values: tuple[str, ...], what: str) -> None:
    if value is not None and value not in values:
        raise QueryError(f"Unsupported {what}: {value!r}. Expected one of: {', '.join(values)}.")


def list_transcripts(t: Mapping[str, DataFrame], conversation_id: str | None = None) -> DataFrame:
    return _find(t, "transcripts", conversation_id=conversation_id).select(*TRANSCRIPT_COLUMNS).orderBy("fetched_at", "transcript_id")


def get_transcript(t: Mapping[str, DataFrame], transcript_id: str) -> dict:
    row = _find(t, "transcripts", transcript_id=transcript_id).select(*TRANSCRIPT_COLUMNS).first()
    if row is None:
        raise QueryError(f"Unknown transcript_id: {transcript_id!r}")
    return row.asDict()


def list_transcript_messages(t: Mapping[str, DataFrame], transcript_id: str) -> DataFrame:
    names = ("transcript_id", "conversation_id", "message_index", "role", "text", "timestamp", "provenance_json")
    return _find(t, "transcript_messages", transcript_id=transcript_id).select(*names).orderBy("message_index")


def list_message_blocks(t: Mapping[str, DataFrame], transcript_id: str) -> DataFrame:
    names = ("transcript_id", "message_index", "block_index", "block_type", "text", "language", "metadata_json")
    return _find(t, "transcript_message_blocks", transcript_id=transcript_id).select(*names).orderBy("message_index", "block_index")


def list_claims(
    t: Tables,
    conversation_id: str | None = None,
    speaker_role: str | None = None,
    speech_act_type: str | None = None,
    transcript_id: str | None = None,
) -> DataFrame:
    _member(speaker_role, SPEAKER_ROLES, "speaker role")
    _member(speech_act_type, SPEECH_ACT_TYPES, "speech-act type")
    rows = _find(t, "claim_ledger", conversation_id=conversation_id, speaker_role=speaker_role, speech_act_type=speech_act_type, transcript_id=transcript_id)
    return rows.select(*CLAIM_COLUMNS).orderBy("created_at", "run_id", "claim_sequence")


def claim_sources(t: Mapping[str, DataFrame], claims: DataFrame | None = None) -> DataFrame:
    """Each claim with its source message and, if it points at one, its source block, as structs (null if not there)."""
    claims = (t["claim_ledger"] if claims is None else claims).select(F.struct(*CLAIM_COLUMNS).alias("claim"))
    m = t["transcript_messages"].select(
        F.col("transcript_id").alias("_t"), F.struct("message_index", "role", "text", "timestamp", "provenance_json").alias("source_message")
    )
    b = t["transcript_message_blocks"].select(
        F.col("transcript_id").alias("_bt"),
        F.col("message_index").alias("_bm"),
        F.struct("block_index", "block_type", "text", "language", "metadata_json").alias("source_block"),
    )
    c = F.col("claim")
    out = claims.join(m, (c["transcript_id"] == F.col("_t")) & (c["source_message_index"] == F.col("source_message.message_index")), "left")
    on = (c["transcript_id"] == F.col("_bt")) & (c["source_message_index"] == F.col("_bm")) & (c["source_block_index"] == F.col("source_block.block_index"))
    return out.join(b, on, "left").select("claim", "source_message", "source_block")


def get_claim_source(t: Mapping[str, DataFrame], claim_id: str) -> dict:
    row = claim_sources(t, _find(t, "claim_ledger", claim_id=claim_id)).first()
    if row is None:
        raise QueryError(f"Unknown claim_id: {claim_id!r}")
    found = row.asDict(recursive=True)
    if found["claim"]["source_block_index"] is None:
        del found["source_block"]
    return found


def list_extraction_runs(t: Mapping[str, DataFrame], transcript_id: str | None = None) -> DataFrame:
    outputs = t["extraction_outputs"].select(
        "run_id", F.col("file_path").alias("raw_output_path"), F.col("sha256").alias("raw_output_sha256"), F.col("byte_size").alias("raw_output_byte_size")
    )
    return _find(t, "extraction_runs", transcript_id=transcript_id).join(outputs, "run_id", "left").orderBy("started_at", "run_id")


def list_support_checks(t: Mapping[str, DataFrame], claim_id: str | None = None, run_id: str | None = None, support_verdict: str | None = None) -> DataFrame:
    _member(support_verdict, SUPPORT_VERDICTS, "support verdict")
    rows = _find(t, "claim_support_checks", claim_id=claim_id, run_id=run_id, support_verdict=support_verdict)
    return rows.select(*TABLES["claim_support_checks"].fieldNames()).orderBy("created_at", "check_id")


def current_claims(t: Mapping[str, DataFrame]) -> DataFrame:
    """Claims that no other claim supersedes."""
    gone = t["claim_ledger"].select(F.col("supersedes_claim_id").alias("claim_id")).dropna()
    return t["claim_ledger"].join(gone, "claim_id", "left_anti").select(*CLAIM_COLUMNS)
