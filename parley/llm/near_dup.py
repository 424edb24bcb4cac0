"""MinHash near-dedup (operator 5) with HyperMinHash registers.

1. A pass over the texts: each text's set of word shingles as one 128-bit key, and 128 HyperMinHash registers of 16 bits
   (leading-zero count and mantissa). Texts of one set are one class, whose smallest id stands for it: a group of copies
   is one row from here on.
2. Registers are banded, 4 to a band: classes that agree in a band meet in a bucket. At the similarity sought two sets
   miss each other in all 32 bands with a chance of about 5e-8. Buckets of the same members are looked at once.
3. In a bucket the collision-corrected Jaccard estimate (five deviations of tolerance) joins classes to loose groups, of
   which a spanning forest leaves: at most as many rows as members, not pairs.
4. Components of these forests are candidate groups. Their texts are brought together, and links are confirmed on the full
   sets by a search that compares each member with those not yet reached; a spanning forest leaves.
5. Components of the confirmed links are the result.

Buckets and groups beyond ``CELL`` are dealt into chunks that all hold the group's hub: near copies join it there, so a
group of very many copies costs a pass over its members. Only what isn't joined with the hub meets all chunks (``linked``),
so that no link is lost; groups of very many members that are unlike each other pay for that.

No pairs within a group are emitted, nothing but counts comes to the driver, every cut of lineage lies in the shared
folder. Chance: 64 bits name a class and its shingles; false links need a collision of these.

Defined results: null or blank texts have an empty set and stay alone; a row with a null id takes no part and is kept
with a null component; repeated rows share a component, and each row of the smallest id is kept; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, release, sieved, sliced, spare
from .graph import components
from .shingles import REGISTERS, estimate, expected_collisions, registers, set_key, shingle_set

#: Defaults of the general operator; the query sets its own.
WORDS, PERCENT = 5, 80
BAND = 4
BANDS = REGISTERS // BAND
#: Members of a chunk, and shingles of a chunk in confirmation.
CELL = 1024
#: Members of a bucket's chunk, of which only registers are compared.
BUCKET = 4096
CELL_SHINGLES = 1 << 19
TOLERANCE = 5.0


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, n_shingles, nid, cid, regs) per row; nid is the first half of the set's key cid, null for empty sets."""
    kind = dict(docs.select(key).dtypes)[key]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n, nid, cid, regs = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                n.append(len(s))
                if len(s):
                    k = set_key(s)
                    cid.append(k)
                    nid.append(int.from_bytes(k[:8], "little", signed=True))
                    regs.append(registers(s).tobytes())
                else:
                    for x in (cid, nid, regs):
                        x.append(None)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(nid, pa.int64()), pa.array(cid, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_shingles", "nid", "cid", "regs"])

    return docs.select(key, text).mapInArrow(task, f"`{key}` {kind}, n_shingles long, nid long, cid binary, regs binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns, across batches; rows come sorted by them."""
    rest: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for k in ks:
            new[1:] |= k[1:] != k[:-1]
        new[0] = last is not None and tuple(k[0] for k in ks) != last
        starts = np.flatnonzero(new)
        at = 0
        for s in starts.tolist():
            if s > at:
                rest.append(b.slice(at, s - at))
            if rest:
                yield pa.Table.from_batches(rest)
            rest, at = [], s
        rest.append(b.slice(at))
        last = tuple(k[-1] for k in ks)
    if rest:
        yield pa.Table.from_batches(rest)


def _bounds(filled: np.ndarray, percent: int) -> np.ndarray:
    """Estimates below this don't come from sets that are similar enough."""
    j = percent / 100
    return j - TOLERANCE * np.sqrt(j * (1 - j) / np.maximum(filled, 1))


#: Of a cell's rows: the members' names, and for a member and others those of the others that it is linked with.
Links = Callable[[int, np.ndarray], np.ndarray]
Load = Callable[[pa.Table], tuple[np.ndarray, Links]]


def by_estimate(percent: int) -> Load:
    """Links by estimates from registers (columns nid, n, regs)."""

    def load(g: pa.Table) -> tuple[np.ndarray, Links]:
        nid, first = np.unique(g.column("nid").to_numpy(), return_index=True)
        n = g.column("n").to_numpy()[first]
        regs = np.frombuffer(b"".join(g.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)[first]

        def links(p: int, rest: np.ndarray) -> np.ndarray:
            own, other = regs[p], regs[rest]
            agree = ((other == own) & (own > 0)).sum(axis=1)
            filled = ((other > 0) | (own > 0)).sum(axis=1)
            collide = np.array([expected_collisions(n[p], m) for m in n[rest]]) if len(rest) < 8 else expected_collisions(n[p], int(n[rest].min()))
            close = np.minimum(n[rest], n[p]) * 100 >= percent * np.maximum(n[rest], n[p])
            return rest[close & (estimate(agree, filled, collide) >= _bounds(filled, percent))]

        return nid, links

    return load


def by_sets(words: int, percent: int) -> Load:
    """Links that hold on the full sets (columns nid, text)."""

    def load(g: pa.Table) -> tuple[np.ndarray, Links]:
        known: dict[int, np.ndarray] = {}
        for k, t in zip(g.column("nid").to_pylist(), g.column("text"), strict=True):
            if k not in known:
                s = shingle_set(t.as_py(), words)
                if len(s) and int.from_bytes(set_key(s)[:8], "little", signed=True) == k:  # else a row of the same id, but another text
                    known[k] = s
        nid = np.array(sorted(known), np.int64)
        sets = [known[k] for k in nid.tolist()]
        if not sets:
            return nid, lambda p, rest: rest[:0]
        sizes = np.array([len(s) for s in sets])
        vocab, dense = np.unique(np.concatenate(sets), return_inverse=True)
        parts = np.split(dense, np.cumsum(sizes)[:-1])
        mask = np.zeros(len(vocab), bool)

        def links(p: int, rest: np.ndarray) -> np.ndarray:
            close = rest[np.minimum(sizes[rest], sizes[p]) * 100 >= percent * np.maximum(sizes[rest], sizes[p])]
            if not len(close):
                return close
            mask[parts[p]] = True
            both = mask[np.concatenate([parts[q] for q in close])]
            mask[parts[p]] = False
            starts = np.r_[0, np.cumsum(sizes[close])[:-1]]
            shared = np.add.reduceat(both, starts, dtype=np.int64)
            return close[100 * shared >= percent * (sizes[close] + sizes[p] - shared)]

        return nid, links

    return load


def forest(n: int, links: Links, first: int = 0) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest, and the members that ``first`` doesn't reach. Each reached member is compared with those
    not yet reached."""
    edges: list[tuple[int, int]] = []
    rest, frontier = np.delete(np.arange(n), first), [first]
    strays = None
    while len(rest):
        if not frontier:
            strays = rest if strays is None else strays
            frontier, rest = [int(rest[0])], rest[1:]
        p = frontier.pop()
        hit = links(p, rest)
        edges += ((p, int(q)) for q in hit)
        frontier += hit.tolist()
        rest = np.setdiff1d(rest, hit, assume_unique=True)
    return edges, np.arange(0) if strays is None else strays


def links_of(asks: np.ndarray, links: Links) -> list[tuple[int, int]]:
    """Edges that join all members which a link of an asking one joins: these are compared with all, others with them."""
    edges: list[tuple[int, int]] = []
    fresh = np.ones(len(asks), bool)
    for root in np.flatnonzero(asks).tolist():
        frontier = [root] if fresh[root] else []
        fresh[root] = False
        while frontier:
            p = frontier.pop()
            hit = links(p, np.flatnonzero(fresh if asks[p] else fresh & asks))
            edges += ((p, int(q)) for q in hit)
            frontier += hit.tolist()
            fresh[hit] = False
    return edges


_FOUND = "g long, a long, b long"


def _cells(keys: int, solve: Callable[[pa.Table], tuple[list[int], list[int | None]]]):
    """A task that gives (g, a, b) for each cell: an edge, or a stray ``a`` where b is null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], []]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["g", "a", "b"])

        for g in grouped(batches, keys):
            a, b = solve(g)
            for x, more in zip(rows, ([g.column(0)[0].as_py()] * len(a), a, b), strict=True):
                x += more
            if len(rows[0]) >= 50_000:
                yield out()
                rows = [[], [], []]
        if rows[0]:
            yield out()

    return task


def linked(small: DataFrame, big: DataFrame | None, load: Load, cell: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) whose components are those of all links within groups, and tables to release after use.

    ``small`` and ``big``: (g, chunks, hub, nid, …), of which ``load`` reads the rest: groups of one chunk, and written
    ones of more (or None), of about ``cell`` members a chunk. A group of one chunk is one cell. A larger one
    is dealt into chunks, and its hub goes to each; what is joined with the hub there is joined with all the others that
    are. Only strays, which aren't, meet the members of all chunks. Rows grow with a group's members, and beyond that
    with its strays times its chunks.
    """

    def first(g: pa.Table) -> tuple[list[int], list[int | None]]:
        nid, links = load(g)
        if not len(nid):
            return [], []
        hub, several = g.column("hub")[0].as_py(), g.column("chunks")[0].as_py() > 1
        at = np.flatnonzero(nid == hub)
        edges, strays = forest(len(nid), links, int(at[0]) if len(at) else 0)
        if several and not len(at):
            strays = np.arange(len(nid))
        lone = nid[strays].tolist() if several else []
        return [int(nid[p]) for p, _ in edges] + lone, [int(nid[q]) for _, q in edges] + [None] * len(lone)

    def second(g: pa.Table) -> tuple[list[int], list[int | None]]:
        nid, links = load(g)
        asking = g.filter(g.column("asks")).column("nid").to_numpy()
        edges = links_of(np.isin(nid, asking), links)
        return [int(nid[p]) for p, _ in edges], [int(nid[q]) for _, q in edges]

    rest = [c for c in small.columns if c not in ("g", "chunks", "hub")]
    own = F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int")
    chunks = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    cells = small.select("g", F.lit(0).alias("c"), "chunks", "hub", *rest)
    if big is not None:
        places = F.when(F.col("nid") == F.col("hub"), chunks("chunks")).otherwise(F.array(own))
        cells = cells.unionByName(big.select("g", F.explode(places).alias("c"), "chunks", "hub", *rest))
    cells = cells.repartition("g", "c").sortWithinPartitions("g", "c", "nid")
    found = cut(cells.mapInArrow(_cells(2, first), _FOUND), f"{name}-cells")
    edges = found.filter("b is not null").select("a", "b")
    strays = found.filter("b is null").select("g", F.col("a").alias("nid"))
    if big is None or strays.isEmpty():
        return edges, [found]
    sets = cut(strays.groupBy("g").agg(F.ceil(F.count("*") / cell).alias("sets")), f"{name}-strays")
    met = big.join(sets, "g")
    asking = met.join(strays.distinct(), ["g", "nid"])
    asking = asking.select("g", F.pmod(F.xxhash64("nid"), F.col("sets")).cast("int").alias("s"), F.explode(chunks("chunks")).alias("c"), F.lit(True).alias("asks"), *rest)
    others = met.select("g", F.explode(chunks("sets")).alias("s"), own.alias("c"), F.lit(False).alias("asks"), *rest)
    cells = asking.unionByName(others).repartition("g", "s", "c").sortWithinPartitions("g", "s", "c", "nid")
    return edges.unionByName(cells.mapInArrow(_cells(3, second), _FOUND).select("a", "b")), [found, sets]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept): per row the smallest key that it is linked with."""
    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    sig = cut(signatures(own, "_id", "_text", words), "near-sig")
    named = sig.filter("nid is not null and _id is not null")
    classes = cut(
        named.groupBy("cid").agg(F.min("_id").alias("rep"), F.first("nid").alias("nid"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")),
        "near-classes",
    )

    # buckets; a band whose registers are all empty says nothing
    width = 2 * BAND
    at = F.sequence(F.lit(0), F.lit(BANDS - 1))
    piece = lambda i: F.substring(F.col("regs"), i * width + 1, F.lit(width))
    filled = F.filter(at, lambda i: piece(i) != F.lit(b"\0" * width))
    keys = F.transform(filled, lambda i: F.xxhash64(i, piece(i)))
    bands = classes.select("nid", F.explode(keys).alias("k"))
    buckets = bands.groupBy("k").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("nid")).alias("x"), F.min("nid").alias("hub")).filter("size > 1")
    once = buckets.groupBy("size", "x", "hub").agg(F.min("k").alias("k")).select("k", F.ceil(F.col("size") / BUCKET).alias("chunks"), "hub")
    once = cut(once, "near-once")
    # of bands, registers and, below, texts, only those move that have a partner, as far as a sieve can tell
    met = cut(sieved(bands, once, ["k"]).join(once, "k").select(F.col("k").alias("g"), "chunks", "hub", "nid"), "near-buckets")
    release(once)
    members = lambda which: met.filter(which).join(sieved(classes.select("nid", "n", "regs"), met.filter(which), ["nid"]), "nid")
    big = None if met.filter("chunks > 1").isEmpty() else cut(members("chunks > 1"), "near-big")
    edges, used = linked(members("chunks = 1"), big, by_estimate(percent), BUCKET, "near-loose")
    loose = components(edges, "near-loose")
    release(met, *([] if big is None else [big]), *used)

    # candidate groups with their texts
    rows = loose.select(F.col("node").alias("nid"), F.col("label").alias("g")).join(classes.select("nid", "rep", "n"), "nid")
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("nid").alias("hub")).filter("size > 1")
    sizes = sizes.select("g", F.ceil(F.greatest(F.col("size") / CELL, F.col("total") / CELL_SHINGLES)).alias("chunks"), "hub")
    sizes = cut(sizes, "near-sizes")  # a join of two plain shuffles can be split where one group is very large
    wanted = cut(rows.join(sizes, "g").select("g", "chunks", "hub", "nid", F.col("rep").alias("_id")), "near-wanted")
    texts = lambda which: sieved(own, wanted.filter(which), ["_id"]).join(wanted.filter(which), "_id").select("g", "chunks", "hub", "nid", F.col("_text").alias("text"))
    big = None if sizes.filter("chunks > 1").isEmpty() else cut(texts("chunks > 1"), "near-big")
    edges, used = linked(texts("chunks = 1"), big, by_sets(words, percent), CELL, "near-linked")
    joined = components(edges, "near-linked")
    release(*([] if big is None else [big]), *used)

    release(loose, sizes, wanted)
    ends = classes.select("nid", "rep").join(joined.select(F.col("node").alias("nid"), "label"), "nid", "left")
    ends = ends.select("nid", "rep", F.coalesce("label", "nid").alias("label"))
    least = cut(ends.groupBy("label").agg(F.min("rep").alias("component_id")), "near-least")
    of_class = ends.join(least, "label").select("nid", "component_id")
    out = sig.select("_id", "n_shingles", "nid").join(of_class, "nid", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    out = cut(out.select("_id", "n_shingles", component.alias("component_id")), "near-result")
    release(sig, classes, joined, least)
    same = F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("_id").alias(key), "n_shingles", "component_id", same.alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group, of its smallest id; of rows that share it,
    or of rows without an id where no other has one, any single one. Rows without words stay."""
    # rows are numbered, so that repeated and missing ids don't matter; written, so that a number stays with its row
    row = spare(docs, "_row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = near_duplicates(rows, row, text, words, percent).select(F.col(row).alias("row"), "component_id")
    ids = rows.select(F.col(row).alias("row"), F.col(key).isNull().alias("none"), F.col(key).alias("id"))
    first = found.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("none", "id", "row"))["row"].alias(row))
    return rows.join(first.select(row), row, "left_semi").select(*docs.columns)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                   ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d),
c AS (SELECT list_sort(sh) AS sh, min(doc_id) AS rep, len(list_sort(sh)) AS n FROM s GROUP BY ALL),
x AS (SELECT rep, n, unnest(sh) AS t FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep
      AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, seen) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE m.component_id END AS component_id,
       CASE WHEN len(s.sh) = 0 THEN TRUE ELSE s.doc_id = m.component_id END AS kept
FROM s JOIN c ON list_sort(s.sh) = c.sh JOIN m ON m.node = c.rep
"""
