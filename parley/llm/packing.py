"""Best-fit packing (operator 7): bounded-space best-fit with look-ahead.

A task encodes its documents with the tokenizers library (each distinct word once, behind a bounded cache), cuts only what
is longer than a sequence, and places each piece in the open bin that it fills best. Open bins are at most ``OPEN_BINS``; a
bitset over free space (one big integer) finds the best fit in a shift; when a new bin is needed and all are open, the
fullest closes. Pieces wait in a window of ``WINDOW`` and leave it longest first, so that long pieces open bins and short
ones fill them: within a window this is best-fit decreasing, over windows it is online.

No shuffle: a task packs what it reads, so the ends of tasks cost at most their last open bins. Memory is one batch,
the window and the open bins. Sequence ids are the task's number and a counter, the same when a task runs again.

Defined results: a null or empty text is one piece of one token (the end mark); repeated rows are packed one by one; an
empty table gives an empty table; only the key and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import codec, default_path
from .common import read, sliced

LENGTH = 4096
END_ID = 1
OPEN_BINS = 1024
WINDOW = 16_384


class OpenBins:
    """A fixed number of open bins, found by free space."""

    def __init__(self, length: int = LENGTH, most: int = OPEN_BINS, first: int = 0):
        self.length, self.most, self.next = length, most, first
        self.free = 0  # bit f: a bin with f free places is open
        self.bins: defaultdict[int, list[int]] = defaultdict(list)
        self.open = 0

    def _take(self, f: int) -> int:
        bins = self.bins[f]
        b = bins.pop()
        if not bins:
            self.free &= ~(1 << f)
        self.open -= 1
        return b

    def put(self, n: int) -> tuple[int, int]:
        """The bin of a piece of ``n`` places, and its offset there."""
        fits = self.free >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            f, b = self.length, self.next
            self.next += 1
        if f > n:
            self.bins[f - n].append(b)
            self.free |= 1 << (f - n)
            self.open += 1
        return b, self.length - f


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    window: int = WINDOW,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as little-endian 32-bit numbers."""
    path = path or default_path()
    kind = dict(docs.select(key).dtypes)[key]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, "bytes", "library")
        end = end_id.to_bytes(4, "little")
        bins = OpenBins(length, open_bins, TaskContext.get().partitionId() << 40)
        held: list[tuple] = []
        key_type = None

        def placed(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: -r[3])
            out = [(*r[:5], *bins.put(r[3]), *r[5:]) for r in rows]
            columns = list(zip(*out, strict=True))
            types = [key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [key, *NAMES[1:], "ids"][: len(columns)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=False)], names=names)

        for b in sliced(batches):
            key_type = b.schema.field(0).type
            for k, row in zip(b.column(0).to_pylist(), c.values(b.column(1).to_pylist()), strict=True):
                ids = b"".join(row) + end
                for i, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    piece = (k, i, at // 4, len(part) // 4, zlib.crc32(part))
                    held.append((*piece, part) if with_ids else piece)
                if len(held) >= window:
                    yield placed(held)
                    held = []
        if held:
            yield placed(held)

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return docs.select(key, text).mapInArrow(task, schema + (", ids binary" if with_ids else ""))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
