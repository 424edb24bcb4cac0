"""Suffix-array dedup (operator 1): bytes that a string of ``length`` bytes covers which also starts elsewhere are removed.

1. A window of ``length`` bytes has one anchor: its k-gram of smallest hash (the last of equals). Equal windows have equal
   anchors, so a pass over the texts leaves one row per run of windows with one anchor: the anchor's hash, a hash of the
   run's bytes, and where it is. Texts go by a content key (md5), so rows may repeat and ids may be missing.
2. Anchors that occur once are dropped. Runs whose bytes occur twice or more are repeated as a whole, and no text moves
   for them: a passage that a third of all documents hold is counted by partial aggregates.
3. One run of each remaining kind (same anchor, other bytes) gives its bytes. They meet by anchor, and for common anchors
   by part of the offset range and the bytes that all windows of the part share, so that large groups split. In a task the
   runs' bytes on both sides of the anchor become blocks, and a suffix array by grouping construction (``suffix.py``) over
   all of them gives both orders; neighbours' common prefixes then tell for every offset which windows occur twice. At an
   anchor of so many kinds that a part is one offset, a part's windows are all equal, and counts decide.
4. Spans of a text are collected (at most its length) and joined with the texts, where bytes are removed.

Everything after the first pass moves places and hashes; texts move twice, by their key. No pairs are made. Cuts of
lineage lie in the shared folder. Hashes of 64 bits within an anchor's group, and md5, stand for equality of bytes.
Anchors and runs of very many rows are joined apart (``join_counted``), so that they are no single task's work.

The same steps take words instead of bytes (``unit``): a word is the 8 bytes of its hash, and places and lengths count
words. The pipeline removes both kinds, so that no number of bytes decides whether a passage of 51 words is found.

``repeat_digest`` removes every copy of a repeated string; its column ``text`` is what a corpus needs besides: there, of
passages of ``words`` words the first stays, by key and then place. ``remove_repeats`` leaves the first, too, so that each
passage stays once in the corpus: texts go by row there, each run kind is represented by its first row, and of equal
windows all but the first count. In ``repeat_digest``, where rows of one text go by its content, a text's first row has
the windows that count, and its other rows lose all words.

Defined results: a null text is empty; texts shorter than ``length`` have no spans, and copies of longer ones lose all
bytes (``remove_repeats``: all but the first row; rows without a key come last, and rows of one key in the table's
order, as in ``text``); repeated rows count as copies; an empty table gives an empty table. ``repeat_digest`` reads the key
and the text only; ``remove_repeats`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_counted, read, release, sliced, spare
from .near_dup import grouped
from .shingles import mix
from .suffix import suffix_array

LENGTH = 400
GRAM = 32
#: Words of the shortest passage that the pipeline removes, words of an anchor, and bytes that stand for a word.
WORDS = 51
WORD_GRAM = 8
WORD_UNIT = 8
#: Windows of one segment; a longer text is read in segments, and places fit in PLACE_BITS.
SEGMENT = 1 << 20
PLACE_BITS = 21
#: Runs of an anchor from which its offsets are dealt out in parts.
SPLIT = 256
BLOCK = 64
#: Rows that share one suffix array.
BATCH_ROWS = 4000

_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_IS_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 17)
        inverse = pow(_ODD, -1, 1 << 64)
        for name, base in (("up", _ODD), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on."""
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` neighbours, in linear time."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def run_arrays(data: bytes, length: int, gram: int, unit: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays, a segment each: anchor's hash, hash of the run's bytes, anchor's place, first and last window of each run."""
    n = len(data) // unit
    for base in range(0, n - length + 1, SEGMENT):
        part = np.frombuffer(data, np.dtype(f"u{unit}"), min(SEGMENT + length - 1, n - base), base * unit)
        h = gram_hashes(part, gram)
        last = (1 << PLACE_BITS) - 1
        packed = (h & ~np.uint64(last)) | (np.uint64(last) - np.arange(len(h), dtype=np.uint64))
        m = sliding_min(packed, length - gram + 1)
        ends = np.append(np.flatnonzero(m[1:] != m[:-1]), len(m) - 1)
        starts = np.append(0, ends[:-1] + 1)
        q = (np.uint64(last) - (m[starts] & np.uint64(last))).astype(np.int64)
        places = zip(((base + starts) * unit).tolist(), ((base + ends + length) * unit).tolist(), (q - starts).tolist(), strict=True)
        own = np.array([xxhash.xxh3_64_intdigest(data[a:z], k) for a, z, k in places], np.uint64)
        yield h[q].astype(np.int64), (own ^ np.uint64(1 << 63)).view(np.int64), base + q, base + starts, base + ends


def runs(data: bytes, length: int, gram: int, unit: int = 1) -> Iterator[tuple[int, int, int, int, int]]:
    """The same, run by run."""
    for x in run_arrays(data, length, gram, unit):
        yield from zip(*(c.tolist() for c in x), strict=True)


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def coded(text: str | None, unit: int) -> bytes:
    """The bytes of the text, or a hash of 8 bytes for each word; words are runs without ASCII white space."""
    data = _encode(text)
    if unit == 1:
        return data
    # hashing a word again costs less than looking it up
    return b"".join(map(xxhash.xxh3_64_digest, data.split()))


def anchor_rows(length: int, gram: int, kind: str, unit: int = 1):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "id", "fp", "h", "q", "s", "e"]
        for b in sliced(batches):
            found: list[tuple[np.ndarray, ...]] = []
            size = 0
            for i, t in enumerate(b.column(2)):
                for r in run_arrays(coded(t.as_py(), unit), length, gram, unit):
                    found.append((np.full(len(r[0]), i), *r))
                    size += len(r[0])
                    if size > 200_000:
                        yield out(b, found, names)
                        found, size = [], 0
            if found:
                yield out(b, found, names)

    def out(b: pa.RecordBatch, found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
        at, *rows = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(0).take(at), *rows], names=names)

    return task, f"cid binary, id {kind}, fp long, h long, q long, s long, e long"


def contexts(length: int, kind: str, unit: int = 1):
    """Rows (text, id, cid, wanted: array of (fp, n, q, s, e)) to one row per run and part of its offsets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "part", "core", "q", "lo", "hi", "left", "right", "id", "cid"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

        def out(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at))], names=names)

        for b in sliced(batches):
            rows: list[tuple] = []
            at: list[int] = []
            size = 0
            for i, (t, wanted) in enumerate(zip(b.column(0), b.column(3), strict=True)):
                data = coded(t.as_py(), unit)
                for w in wanted.as_py():
                    q = w["q"]
                    first, last = q - w["e"], q - w["s"]  # offsets of the anchor in its windows
                    parts = min(length, -(-w["n"] // SPLIT))
                    step = -(-length // parts)
                    for p in range(first // step, last // step + 1):
                        lo, hi = max(first, p * step), min(last, (p + 1) * step - 1)
                        # bytes that all windows of the part hold
                        common = data[(q - p * step) * unit : (q + length - min(length - 1, (p + 1) * step - 1)) * unit]
                        if step == 1:  # the whole window
                            left = right = b""
                        else:
                            left, right = data[(q - hi) * unit : q * unit][::-1], data[q * unit : (q + length - lo) * unit]
                        rows.append((w["fp"], p, xxhash.xxh3_64_intdigest(common) - (1 << 63), q, lo, hi, left, right))
                        at.append(i)
                        size += len(left) + len(right) + 64
                if size > 1 << 24:
                    yield out(b, at, rows)
                    rows, at, size = [], [], 0
            if rows:
                yield out(b, at, rows)

    schema = "fp long, part int, core long, q long, lo int, hi int, left binary, right binary"
    return task, f"{schema}, id {kind}, cid binary"


def ordered(sides: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and then bytes, and how many bytes each shares with the row before it in that order.

    A row is its group's mark and its bytes in blocks; one suffix array of all rows holds the order of the marks.
    """
    lengths = np.array([len(x) for x in sides])
    width = max(1, int(-(-lengths.max() // BLOCK))) * BLOCK
    wide = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sides), np.uint8).reshape(len(sides), width)
    blocks = np.ascontiguousarray(wide).view(f"S{BLOCK}").reshape(len(sides), -1)
    used = np.arange(blocks.shape[1]) < (-(-lengths // BLOCK))[:, None]
    kinds, rank = np.unique(blocks[used], return_inverse=True)
    counts = used.sum(axis=1)
    marks = np.r_[0, np.cumsum(counts + 1)[:-1]]
    symbols = np.empty(int(counts.sum()) + len(sides), np.int64)
    is_mark = np.zeros(len(symbols), bool)
    is_mark[marks] = True
    symbols[marks] = len(kinds) + 1 + group
    symbols[~is_mark] = rank + 1
    sa = suffix_array(symbols)
    row_at = np.full(len(symbols), -1)
    row_at[marks] = np.arange(len(sides))
    order = row_at[sa[is_mark[sa]]]
    differ = wide[order[1:]] != wide[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.r_[0, shared]


def repeated_windows(length: int, unit: int = 1, first: bool = False):
    """Groups (fp, part, core) of runs to spans (cid, s, e) of bytes that their repeated windows cover; with ``first``,
    runs come in the order of their texts, and the first of equal windows is left out."""

    def solve(rows: list[dict], starts: list[int]) -> Iterator[tuple]:
        group = np.zeros(len(rows), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        lo, hi = np.array([r["lo"] for r in rows]), np.array([r["hi"] for r in rows])
        by = [ordered([r[side] for r in rows], group) for side in ("left", "right")]
        # rows of a group stand together in both orders, in the same place
        for a, z in zip(starts, [*starts[1:], len(rows)], strict=True):
            n = z - a
            if n == 2:  # the windows that both rows hold are one range of offsets
                left, right = (int(shared[a + 1]) // unit for _, shared in by)
                x, y = max(int(lo[a:z].max()), length - right), min(int(hi[a:z].min()), left)
                for r in rows[a + first : z] if x <= y else ():
                    yield r["cid"], r["q"] - y, r["q"] - x + length
                continue
            depth = np.arange(lo[a:z].min(), hi[a:z].max() + 1)
            classes = []
            for (order, shared), need in zip(by, (depth, length - depth), strict=True):
                new = shared[a:z][None, :] // unit < need[:, None]
                new[:, 0] = True
                of = np.empty((len(depth), n), np.int64)
                of[:, order[a:z] - a] = np.cumsum(new, axis=1)
                classes.append(of)
            key = classes[0] * (n + 1) + classes[1]
            valid = (depth[:, None] >= lo[a:z]) & (depth[:, None] <= hi[a:z])
            key[~valid] = -1
            place = np.argsort(key, axis=1, kind="stable")
            key = np.take_along_axis(key, place, axis=1)
            same = (key[:, 1:] == key[:, :-1]) & (key[:, 1:] >= 0)
            twice = np.zeros((len(depth), n), bool)
            twice[:, 1:] |= same
            if not first:
                twice[:, :-1] |= same
            hit = np.zeros_like(twice)
            np.put_along_axis(hit, place, twice, axis=1)
            for i in np.flatnonzero(hit.any(axis=0)).tolist():
                d = depth[hit[:, i]]
                breaks = np.flatnonzero(np.diff(d) > 1)
                r = rows[a + i]
                for x, y in zip(d[np.r_[0, breaks + 1]].tolist(), d[np.r_[breaks, len(d) - 1]].tolist(), strict=True):
                    yield r["cid"], r["q"] - y, r["q"] - x + length

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        starts: list[int] = []

        def out() -> pa.RecordBatch:
            found = list(solve(rows, starts))
            rows.clear()
            starts.clear()
            c, s, e = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["cid", "s", "e"])

        for g in grouped(batches, 3):
            if g.num_rows < 2:
                continue
            own = {(r["cid"], r["q"]): r for r in g.drop_columns(["id"]).to_pylist()}  # a repeated row gives the same run again
            if len(own) < 2:
                continue
            starts.append(len(rows))
            rows += own.values()
            if len(rows) >= BATCH_ROWS:
                yield out()
        if rows:
            yield out()

    return task, "cid binary, s long, e long"


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def repeat_spans(own: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: int = 1, first: bool = False) -> DataFrame:
    """(cid, spans: array of (s, e)) for texts with repeated bytes, or words; ``own`` has id, cid and text.

    With ``first``, the first of equal windows doesn't count, by id and then place. Rows of one cid, which have one text, then
    get the spans of the first of them; ids must be distinct.
    """
    kind = dict(own.dtypes)["id"]
    task, schema = anchor_rows(length, gram, kind, unit)
    anchors = cut(own.select("id", "cid", "text").mapInArrow(task, schema), "repeat-anchors")
    counts = anchors.groupBy("fp").agg(F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1")).filter("n > 1")
    counts = cut(counts.select("fp", "n", (F.col("h0") != F.col("h1")).alias("mixed")), "repeat-counts")
    rows = cut(join_counted(anchors, counts, ["fp"]).drop("n"), "repeat-rows")
    release(anchors, counts)

    kinds = rows.groupBy("fp", "h", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("id", "q", "cid", "s", "e")).alias("r"))
    kinds = cut(kinds, "repeat-kinds")
    span = [F.col("s"), (F.col("e") + length).alias("e")]
    several = kinds.filter("n > 1").select("fp", "h", "n", F.struct("r.cid", "r.q").alias("r0"))
    whole = join_counted(rows.drop("mixed"), several, ["fp", "h"])
    if first:
        whole = whole.filter(F.struct("cid", "q") != F.col("r0"))

    sizes = cut(kinds.filter("mixed").groupBy("fp").agg(F.count("*").alias("n")), "repeat-sizes")
    wanted = join_counted(kinds.filter("mixed").select("fp", "r"), sizes, ["fp"])

    def met(which: DataFrame) -> DataFrame:
        by = which.groupBy("r.cid", "r.id").agg(F.collect_list(F.struct("fp", "n", "r.q", "r.s", "r.e")).alias("wanted"))
        by = by.withColumnsRenamed({"cid": "_cid", "id": "_id"})
        texts = own.join(by, (own["cid"] == by["_cid"]) & own["id"].eqNullSafe(by["_id"])).select("text", "id", "cid", "wanted")
        task, schema = contexts(length, kind, unit)
        return texts.mapInArrow(task, schema)

    many = (length - 1) * SPLIT  # kinds of an anchor beyond which a part is one offset
    groups = met(wanted.filter(F.col("n") <= many)).repartition("fp", "part", "core").sortWithinPartitions("fp", "part", "core", "id", "q")
    task, schema = repeated_windows(length, unit, first)
    found = groups.mapInArrow(task, schema)
    spans = whole.select("cid", *span).unionByName(found)
    if not sizes.filter(F.col("n") > many).isEmpty():
        single = cut(met(wanted.filter(F.col("n") > many)).drop("hi", "left", "right"), "repeat-single")
        equal = single.groupBy("fp", "part", "core").agg(F.count("*").alias("n"), F.min(F.struct("id", "q", "cid")).alias("r")).filter("n > 1")
        equal = cut(equal.select("fp", "part", "core", "n", F.struct("r.cid", "r.q").alias("r0")), "repeat-equal")
        more = join_counted(single, equal, ["fp", "part", "core"])
        if first:
            more = more.filter(F.struct("cid", "q") != F.col("r0"))
        spans = spans.unionByName(more.select("cid", (F.col("q") - F.col("lo")).alias("s"), (F.col("q") - F.col("lo") + length).alias("e")))
    spans = cut(spans.groupBy("cid").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "repeat-spans")
    release(rows, kinds, sizes)
    return spans


def _own(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, cid and text of the rows; ids are distinct and null keys come last. Rows are numbered only where a key repeats,
    and written then, so that a number stays with its row."""
    text = F.coalesce(F.col(text), F.lit(""))
    order = [F.col(key).isNull().alias("none"), F.col(key).alias("key")]
    own = [F.unhex(F.md5(text.cast("binary"))).alias("cid"), text.alias("text")]
    if docs.select(order[1]).groupBy("key").count().filter("count > 1").isEmpty():
        return docs.select(F.struct(*order).alias("id"), *own)
    return cut(docs.select(F.struct(*order, F.monotonically_increasing_id().alias("row")).alias("id"), *own), "repeat-docs")


def _kept(data: bytes, cuts: list[list[int]]) -> list[bytes]:
    """The pieces between the cuts."""
    at = [0, *(e for _, e in cuts)]
    return [data[a:z] for a, z in zip(at, [*(s for s, _ in cuts), len(data)], strict=True)]


def _text(pieces: list[bytes]) -> str:
    """The pieces as text; a character that lost a byte is left out."""
    return "".join(k.decode("utf-8", "ignore") for k in pieces)


def repeat_digest(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, words: int = WORDS
) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, the hash of the bytes that stay, the text that they are (kept_text;
    characters that lost a byte are left out), and text: the document without passages of ``words`` words that also start
    earlier, in a row of a smaller key or before in the text, so that each passage stays once."""
    own = _own(docs, key, text)
    kind = dict(docs.select(key).dtypes)[key]
    parts = {
        "cuts": repeat_spans(own.withColumn("id", F.col("id.key")), length, gram),
        "gone": repeat_spans(own, words, min(words, WORD_GRAM), WORD_UNIT, first=True),
    }
    copied = own.groupBy("cid").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").select("cid", "first")
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*(x.withColumnRenamed("spans", k) for k, x in parts.items()), copied])
    found = found.groupBy("cid").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("cuts", "gone", "first")))
    # the merge hint: texts move at every size, and a third of all texts may be one content
    later = F.coalesce(F.col("id") != F.col("first"), F.lit(False))
    joined = own.join(found.hint("merge"), "cid", "left").select(F.col("id.key"), "text", "cuts", "gone", later)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for t, *spans, again in zip(*b.columns[1:], strict=True):
                data = _encode(t.as_py())
                cuts, gone = ([(x["s"], x["e"]) for x in s.as_py() or ()] for s in spans)
                cuts = merged(cuts)
                kept = _kept(data, cuts)
                sha = hashlib.sha256()
                for k in kept:
                    sha.update(k)
                if again.as_py():
                    n = len(data.split())
                    gone = [(0, n)] if n >= words else []
                first = _text(_kept(data, merged(word_places(data, gone)))) if gone else t.as_py()
                left = _text(kept) if cuts else t.as_py()
                rows.append((len(data), len(data) - sum(map(len, kept)), len(cuts), sha.hexdigest(), left, first))
            columns = zip(*rows, strict=True)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(columns, types, strict=True)]], names=names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "text"]
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, text string"
    return joined.mapInArrow(task, f"`{key}` {kind}, {schema}")


def word_places(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, from the first word's start to the last word's end."""
    word = np.concatenate([[False], _IS_WORD[np.frombuffer(data, np.uint8)], [False]])
    at = np.flatnonzero(word[1:] != word[:-1]).reshape(-1, 2)
    return [(int(at[s, 0]), int(at[e - 1, 1])) for s, e in spans]


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int | None = LENGTH, gram: int = GRAM, words: int | None = None
) -> DataFrame:
    """``docs`` without bytes that a string of ``length`` bytes covers which also starts earlier: in a row of a smaller
    key, in an earlier row of the same key, or before in the text. A character that loses a byte goes as a whole. Rows
    stay, also empty ones.

    With ``words``, the same holds for passages of so many words, however few bytes they have.
    """
    row, found = spare(docs, "_repeat_row"), spare(docs, "_repeat_spans")
    # written, so that a number stays with its row
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "repeat-docs")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    own = rows.select(order.alias("id"), F.unhex(F.lpad(F.hex(row), 16, "0")).alias("cid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = []
    if length:
        parts.append(repeat_spans(own, length, gram, first=True).select("cid", F.lit(False).alias("words"), "spans"))
    if words:
        parts.append(repeat_spans(own, words, min(words, WORD_GRAM), WORD_UNIT, first=True).select("cid", F.lit(True).alias("words"), "spans"))
    spans = reduce(DataFrame.unionByName, parts).groupBy("cid").agg(F.collect_list(F.struct("words", "spans")).alias(found))
    spans = spans.select(F.conv(F.hex("cid"), 16, 10).cast("long").alias(row), found)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(texts, found, strict=True):
            if t is None or x is None:
                out.append(t)
                continue
            data, gone = _encode(t), []
            for f in x:
                places = [(r["s"], r["e"]) for r in f["spans"]]
                gone += word_places(data, places) if f["words"] else places
            out.append(_text(_kept(data, merged(gone))))
        return pd.Series(out, dtype=object)

    joined = rows.join(spans.hint("merge"), row, "left")
    return joined.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(clean(F.col(text), F.col(found)))).drop(row, found)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(read(spark, sf_dir, "documents"))
