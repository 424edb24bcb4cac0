"""Exact top-k search (operator 4) by aggregation without random access.

Vectors become integers, floor(256 * x). Each block of candidates keeps, per dimension, its vectors sorted by that
component, built once; a query reads a list from the end that its own component favours. Lists are read in step, entry
after entry: what has been read gives each candidate a lower bound (unread components are as bad as the list's worst) and
an upper bound (as good as where reading stands). Sums over the entries read are kept and grow with each step; none is
read twice. Once even a candidate of which nothing was read can't reach the k-th best lower bound, upper bounds are
compared, too; reading stops when at most a few candidates can still qualify, or the lists end. The components missing for
those few are then resolved. Queries are read for in small batches, so that a step's arithmetic is vectorized.

How much is read depends on the data: lists of few dimensions, or of skewed ones, stop early; 64 independent dimensions
are read almost to their ends (``shares``; the README has figures), and no bound can prevent that.

Candidates are dealt into blocks of bounded size, the same for repeated rows; the stated queries are copied to each block
and stream through it, so memory is one block and one batch of queries. Each block gives k rows a query, which a window
with Spark's group limit merges. Nothing is broadcast and nothing comes to the driver but a count.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id or
of another length than the query; an empty vector scores 0; scores beyond a long's range count as its nearest bound; a
repeated row is a candidate of its own, except to the queries of its own id, and a repeated query is answered once (of
several vectors of one id, the smallest); ties go to the smaller id; an empty table gives an empty table. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

K = 5
EVERY = 50
SCALE = 256
#: Vectors of a block, and queries that read its lists together.
CANDIDATES, QUERIES = 8192, 128
#: Shares of the lists that are read before the bounds are compared.
DEPTHS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 1.0)
#: Reading stops when so many times k candidates are left.
FEW = 4


def integer_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v: array of long) of the vectors that take part."""
    x = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return df.filter(ok).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


class Lists:
    """The sorted lists of a block: per dimension the vectors' rows and components in ascending order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(self.x.T, self.order, axis=1)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(x), dtype=np.int32)[None, :], axis=1)
        self.reach = max(-int(x.min(initial=-1)), int(x.max(initial=1)))


def read_lists(lists: Lists, q: np.ndarray, qid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one block for each query: (row of q, row of the block, score), and per query the share of
    the lists' entries that were read.

    Sums are taken in 32 or 64 bits, as they need; those beyond 2**53 take Python integers.
    """
    n, dims = lists.x.shape
    most = 2 * lists.reach * max(-int(q.min(initial=-1)), int(q.max(initial=1))) * max(dims, 1)
    if most >= 1 << 53:
        return (*_large(lists.x, lists.ids, q, qid, k), np.ones(len(q)))
    kind = np.int32 if most < 1 << 30 else np.int64
    least = np.iinfo(kind).min // 2
    plus, minus = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    all_values = lists.values.astype(kind)
    low, high = (all_values[:, 0], all_values[:, -1]) if n else (np.zeros(dims, kind), np.zeros(dims, kind))
    sums = np.zeros((n, len(q)), kind)  # over the entries read: how much better they are than the worst of their list
    worst = plus @ low + minus @ high
    own_q, own_x = np.nonzero(qid[:, None] == lists.ids[None, :])
    share = np.ones(len(q))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(len(q))
    done = 0
    for depth in DEPTHS if n > FEW * k and dims else (1.0,):
        at = max(done, int(np.ceil(n * depth)))
        p, m = plus[active], minus[active]
        for d in range(dims):
            rows, values = lists.order[d], all_values[d]
            if p[:, d].any():  # from the high end down
                sums[rows[n - at : n - done]] += np.multiply.outer(values[n - at : n - done] - low[d], p[:, d])
            if m[:, d].any():  # from the low end up
                sums[rows[done:at]] += np.multiply.outer(values[done:at] - high[d], m[:, d])
        done = at
        mine = np.isin(own_q, active)
        place = np.searchsorted(active, own_q[mine])
        lower = sums + worst[active]
        lower[own_x[mine], place] = least
        if at == n:
            out += [(np.full(n, a), np.arange(n), lower[:, i]) for i, a in enumerate(active)]
            break
        kth = np.partition(lower, n - k, axis=0)[n - k]
        front_high, front_low = all_values[:, n - at], all_values[:, at - 1]
        step = np.concatenate([p * (front_high - low), m * (front_low - high)], axis=1)  # what an unread component may add at most
        ready = np.flatnonzero(step.sum(axis=1) + worst[active] < kth)  # what was never seen can't qualify
        if not len(ready):
            continue
        unread = np.concatenate([lists.rank < n - at, lists.rank >= at]).T.astype(np.float64)
        may = lower[:, ready] + unread @ step[ready].T.astype(np.float64) >= kth[ready]
        few = may.sum(axis=0) <= FEW * k
        for i in np.flatnonzero(few).tolist():
            a = active[ready[i]]
            left = np.flatnonzero(may[:, i])
            out.append((np.full(len(left), a), left, lists.x[left] @ q[a]))  # the missing components of the few
            share[a] = at / n
        keep = np.ones(len(active), bool)
        keep[ready[few]] = False
        active, sums = active[keep], np.ascontiguousarray(sums[:, keep])
        if not len(active):
            break
    rows, cols, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    real = score > least
    rows, cols, score = rows[real], cols[real], score[real]
    order = np.lexsort((lists.ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], score[keep].astype(np.int64), share


def _large(x, xid, q, qid, k):
    rows, cols, scores = [], [], []
    wide = x.astype(object)
    for i in range(len(q)):
        s = wide @ q[i].astype(object) if x.shape[1] else np.zeros(len(x), object)
        s = [min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in s]
        best = sorted((j for j in range(len(x)) if xid[j] != qid[i]), key=lambda j: (-s[j], xid[j]))[:k]
        rows += [i] * len(best)
        cols += best
        scores += [s[j] for j in best]
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(scores, np.int64)


def _stacked(ids: pa.Array, v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids, and the vectors as one array."""
    sizes = v.value_lengths().to_numpy()
    flat, ids = v.flatten().to_numpy(), ids.to_numpy()
    starts = np.cumsum(sizes) - sizes
    out = {}
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        out[dims] = ids[rows], flat[starts[rows][:, None] + np.arange(dims)]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shares: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score); both tables are (vec_id, v). ``shares`` adds the share of the list entries that were
    read in the row's block."""
    # a block's number is drawn by row and written, so that repeated rows spread and a lost task draws the same
    vectors = cut(vectors.select("vec_id", "v", F.xxhash64(F.monotonically_increasing_id()).alias("draw")), "topk-vectors")
    blocks = max(1, -(-vectors.count() // CANDIDATES))
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    xs = vectors.select(F.pmod("draw", F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    qs = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score", "share"]
        block, held, lists = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            numbers = b.column(0).to_numpy()
            asks = b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])])
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows], strict=True):
                if numbers[s] != block:
                    block, held, lists = numbers[s], [], None
                part = b.slice(s, e - s)
                if not asks[s]:
                    held.append(part)
                    continue
                if lists is None:  # the block's vectors come before its queries
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
                    lists = {d: Lists(x, i) for w in whole for d, (i, x) in _stacked(w.column(2), w.column(3)).items()}
                    held = []
                for dims, (ids, q) in _stacked(part.column(2), part.column(3)).items():
                    for at in range(0, len(ids), QUERIES):
                        if dims in lists:
                            i = ids[at : at + QUERIES]
                            rows, cols, score, share = read_lists(lists[dims], q[at : at + QUERIES], i, k)
                            found = [i[rows], lists[dims].ids[cols], score, share[rows]]
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    # queries follow the vectors of their block; the tasks are few and heavy, so none are merged
    met = xs.unionByName(qs).repartition(2 * blocks, "block").sortWithinPartitions("block", "asks")
    parts = met.mapInArrow(task, "query_id long, vec_id long, score long, share double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *(["share"] if shares else []))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
