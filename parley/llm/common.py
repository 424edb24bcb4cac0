"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus; paths go through Spark's readers only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that a Python stage works on at a time; Spark bounds the bytes of an Arrow batch (maxBytesPerBatch, 64 MB).
BATCH_ROWS = 2000


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_ROWS."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def spare(df: DataFrame, name: str) -> str:
    """``name``, or with marks added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that it is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of an array: item i is ``step`` over the items before i, from ``start`` on; one more than items.

    ``step`` must be associative and commutative, with ``start`` as its neutral element. Spark's fold copies an array that
    grows, so folds run over pieces of about the root of the length: n items cost n ** 1.5, not n ** 2.
    """

    def fold(part: Column) -> Column:
        """Results after each item of a short array."""
        first = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def add(a: Column, x: Column) -> Column:
            return let(step(a["at"], x), lambda v: F.struct(v.alias("at"), F.concat(a["out"], F.array(v)).alias("out")))

        return F.aggregate(part, first, add, lambda a: a["out"])

    kind = "int"

    def pieces(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.greatest(F.size(v), F.lit(1)))).cast("int")
        starts = lambda k: F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), k)
        return let(size, lambda k: F.transform(starts(k), lambda i: fold(F.slice(v, i, k))))

    def joined(p: Column) -> Column:
        ends = F.transform(p, lambda x: F.coalesce(F.get(x, F.size(x) - 1), start))
        before = lambda b: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda y: step(F.coalesce(F.get(b, i - 1), start), y))))
        return let(fold(ends), before)

    return F.concat(F.array(start), let(values, lambda v: let(pieces(v), joined)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``). Where it is unset, local runs have
    one of their own; on a cluster the warehouse serves, which is shared, too."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        local = sc.master.startswith("local")
        folder = "file://" + tempfile.mkdtemp(prefix="parley-shared-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/parley-shared"
        sc.setCheckpointDir(folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; its folder goes with it
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a lost executor costs no
    upstream work, and Python stages below it run once. The table goes with ``release``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parley-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(spark, set()).add(path)
    spark.sparkContext._jvm.System.gc()  # the shuffles that led here are dead; Spark removes their files with the objects
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


#: Tables of ``cut`` that are still there, by session.
_WRITTEN: dict[SparkSession, set[str]] = {}


@atexit.register
def _drop_all() -> None:
    for spark, paths in _WRITTEN.items():
        for path in paths:
            _drop(spark, path)


def release(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing will read again."""
    for t in tables:
        _drop(t.sparkSession, t._cut_path)
        _WRITTEN.get(t.sparkSession, set()).discard(t._cut_path)


#: Rows of one key from which ``join_counted`` takes it apart, and how many such keys there can be at most.
HOT_ROWS, HOT_KEYS = 4096, 10_000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``keys``, one written row per key that knows in ``n`` how many rows the key has.

    A key of very many rows would be one task's work. Such keys have each more than 1/HOT_KEYS of all rows, so there are
    at most HOT_KEYS of them: they are broadcast, and their rows stay where they are. The others meet by a shuffle.
    """
    limit = max(HOT_ROWS, (keys.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    hot = keys.filter(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(keys, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.filter(F.col(n) <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


#: Bits of ``sieved``.
SIEVE = 1 << 25


def sieved(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those that have no partner in ``keys`` by the columns ``on``, whose types are the same there.

    For joins that would move every row, to find few. A bit is set for the hash of each key; the bits, at most SIEVE / 64
    rows, are broadcast. Rows that share a bit with a key stay, so the join has still to be made.
    """
    word, bits, slot = (spare(rows, x) for x in ("_word", "_bits", "_slot"))
    at = F.pmod(F.xxhash64(*on), F.lit(SIEVE))
    mark = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)).cast("int"))
    set_ = keys.select(at.alias(slot)).select(F.shiftright(slot, 6).alias(word), mark(F.col(slot)).alias(bits))
    set_ = set_.groupBy(word).agg(F.bit_or(bits).alias(bits))
    met = rows.withColumn(slot, at).withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(set_), word)
    return met.filter(F.col(bits).bitwiseAND(mark(F.col(slot))) != 0).select(*rows.columns)
