"""Toxicity (operator 8): a convolutional text classifier trained in numpy.

Words are hashed to embeddings; filters of several widths slide over the whole text, their largest values are pooled
and weighed to one score. All labelled rows that may be learned from are: their whole texts become word hashes, joined
with the labels. About 15 % of their ids, by hash, calibrate, so that calibration sees texts the model hasn't; all others
teach:

1. word counts by label over all teaching rows give the vocabulary and where the embeddings start;
2. the teaching rows are dealt by hash into shards of about ``STEPS * BATCH``, each shard takes gradient steps over all its
   rows from the same start, and the mean of the shards' models is the model (parameter mixing; with one shard, plain
   training);
3. the margins of all calibrating rows, counted in steps of 1/256, give the score's scale and shift and the thresholds.
   Where the teaching or the calibrating rows would lack a label, all rows do both.

To the driver come counts of at most ``BUCKETS`` words, sums of model differences of a row a word, and counts of margins.
Sums are of whole numbers, so that no order of tasks changes them. What is sent to the executors is the model, whose size
``BUCKETS`` bounds. A shard's hashes are one task's memory; shards are at most about ``SHARD_WORDS`` words. Scoring is one
pass by row over whole texts without a shuffle; memory is one Arrow batch, a slice of filter values, the model and a
bounded word cache.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never learned from. Only the text enters a
score; a language only chooses the calibrated threshold of the extra column ``flagged``.

Defined results: a null or empty text gets the score of no words; ids whose labels contradict each other are not learned
from, and of several texts of one id each is; with no labelled rows of both kinds every score is the rate of label 1
among the labels (0 without labels); repeated rows are scored one by one; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, release, sieved, sliced
from .near_dup import grouped

#: Hash space of words; hashes in fewer than LEAST_DOCS of the texts that are learned from share the zero vector.
BUCKETS = 1 << 18
LEAST_DOCS = 4
EMBED, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
#: Least gradient steps of a shard, which takes as many more as its rows need, and texts of a step.
STEPS, BATCH = 800, 32
#: Words of a shard.
SHARD_WORDS = 1 << 24
#: Of 100 ids, how many calibrate.
ASIDE = 15
#: Margins are counted in steps of 1 / MARGIN_STEPS, up to MARGIN_MOST.
MARGIN_STEPS, MARGIN_MOST = 256, 64
#: Fixed point of what shards learn, so that sums don't depend on their order.
UNIT = float(1 << 32)
THRESHOLD = 0.3
PUNCTUATION = ".,;:!?\"'()[]{}<>|*%$&#-_/\\…«»“”’"
CACHE = 200_000
#: Places of a text whose filter values are held at a time.
SLICE = 1 << 16


def bucket_of(word: str) -> int:
    return zlib.crc32(word.strip(PUNCTUATION).lower().encode("utf-8", "replace")) % BUCKETS


@dataclass
class Params:
    """What is trained: embedding rows, a filter per width and place, the pooled values' bias, and their weights."""

    emb: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def _tables(p: Params) -> list[np.ndarray]:
    return [p.emb.astype(np.float32) @ f.astype(np.float32) for f in p.filters]


@dataclass
class Model:
    rows: dict[int, int]  # bucket -> row of the tables; row 0 is the zero vector
    tables: list[np.ndarray]  # per width and place: the embedding rows through the filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0  # calibration of the score
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    params: Params | None = None  # what the tables are made of, which is sent in their place

    @classmethod
    def of(cls, rows: dict[int, int], p: Params) -> Model:
        return cls(rows, _tables(p), p.bias, p.out, p.out_bias, params=p)

    def __getstate__(self) -> dict:
        return self.__dict__ | ({} if self.params is None else {"tables": None})

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if self.tables is None:
            self.tables = _tables(self.params)

    def pooled(self, at: np.ndarray) -> np.ndarray:
        """Largest value of each filter over the text, slice by slice."""
        n, most = len(at) - max(WIDTHS) + 1, None
        for a in range(0, n, SLICE):
            z = min(a + SLICE, n)
            parts, k = [], 0
            for w in WIDTHS:
                values = self.tables[k][at[a:z]]
                for j in range(1, w):
                    values = values + self.tables[k + j][at[a + j : z + j]]
                parts.append(values.max(axis=0))
                k += w
            part = np.concatenate(parts)
            most = part if most is None else np.maximum(most, part)
        return np.maximum(most + self.bias, 0)

    def margin(self, at: np.ndarray) -> float:
        return float(self.pooled(at) @ self.out + self.out_bias)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30))))


def padded(ids: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([np.asarray(ids, np.int32), np.zeros(max(WIDTHS), np.int32)])


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a one-input logistic regression of weighted rows, by damped Newton steps."""
    t = np.array([1.0, 0.0])
    for _ in range(50):
        z = np.clip(t[0] * x + t[1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        a = np.stack([x, np.ones_like(x)])
        g = a @ (w * (p - y)) + 1e-3 * np.array([t[0] - 1, t[1]])
        h = (a * (w * p * (1 - p))) @ a.T + 1e-3 * np.eye(2)
        t = t - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(max(t[0], 1e-3)), float(t[1])


def example_gradient(p: Params, at: np.ndarray, y: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float, dict[int, np.ndarray]]:
    """Gradient of one text's logistic loss, in the order of Params' fields but for the embeddings, which come last, by row."""
    n = len(at) - max(WIDTHS) + 1
    tops = [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
    values = [np.full(FILTERS, -np.inf) for _ in WIDTHS]
    for start in range(0, n, SLICE):
        size = min(SLICE, n - start)
        e, k = p.emb[at[start : start + size + max(WIDTHS) - 1]], 0
        for i, w in enumerate(WIDTHS):
            z = e[:size] @ p.filters[k]
            for j in range(1, w):
                z = z + e[j : size + j] @ p.filters[k + j]
            top = z.argmax(axis=0)
            best = z[top, np.arange(FILTERS)]
            tops[i] = np.where(best > values[i], start + top, tops[i])
            values[i] = np.maximum(values[i], best)
            k += w
    k = 0
    pre = np.concatenate(values) + p.bias
    h = np.maximum(pre, 0)
    err = 1 / (1 + np.exp(-np.clip(h @ p.out + p.out_bias, -30, 30))) - y
    g_bias = err * p.out * (pre > 0)
    g_filters, g_emb = [], {}
    for i, w in enumerate(WIDTHS):
        g = g_bias[i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):
            src = tops[i] + j
            g_filters.append(p.emb[at[src]].T * g)
            back = p.filters[k + j].T * g[:, None]
            for f in range(FILTERS):
                if g[f] and at[src[f]]:  # row 0 is no word and stays zero
                    r = int(at[src[f]])
                    g_emb[r] = g_emb.get(r, 0) + back[f]
        k += w
    return g_filters, g_bias, err * h, float(err), g_emb


def start_params(log_odds: np.ndarray, seed: int = 7) -> Params:
    """Where training starts; ``log_odds``: of a text that holds the word, by row, the first of no word."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(log_odds), EMBED))
    emb[:, 0] = log_odds
    emb[0] = 0
    filters = [rng.normal(0, 0.1, (EMBED, FILTERS)) for w in WIDTHS for _ in range(w)]
    k = 0
    for w in WIDTHS:
        for j in range(w):
            filters[k + j][0] += 0.6 / w * np.linspace(0.5, 1.5, FILTERS)
        k += w
    n_out = FILTERS * len(WIDTHS)
    return Params(emb, filters, np.zeros(n_out), np.full(n_out, 0.1), -1.0)


def learn(start: Params, docs: list[np.ndarray], y: np.ndarray, seed: int) -> Params:
    """Gradient steps from ``start`` over all texts, each at least once."""
    rng = np.random.default_rng(seed)
    p = Params(start.emb.copy(), [f.copy() for f in start.filters], start.bias.copy(), start.out.copy(), start.out_bias)
    params = [*p.filters, p.bias, p.out]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    ob = [0.0, 0.0]
    emb_sq = np.full(len(p.emb), 1e-2)
    train = np.arange(len(docs))
    steps, step = max(STEPS, -(-len(docs) // BATCH)), 0
    while step < steps:
        rng.shuffle(train)
        for at in range(0, min(len(train), (steps - step) * BATCH), BATCH):
            batch = train[at : at + BATCH]
            grads = [np.zeros_like(x) for x in params]
            g_ob, g_emb = 0.0, {}
            for d in batch:
                of_filters, of_bias, of_out, err, of_emb = example_gradient(p, docs[d], y[d])
                for total, g in zip(grads, (*of_filters, of_bias, of_out), strict=True):
                    total += g
                g_ob += err
                for r, g in of_emb.items():
                    g_emb[r] = g_emb.get(r, 0) + g
            step += 1
            for x, g, (m, v) in zip(params, grads, moments, strict=True):
                g = g / len(batch) + 1e-4 * x
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            g = g_ob / len(batch)
            ob[0] += 0.1 * (g - ob[0])
            ob[1] += 0.001 * (g * g - ob[1])
            p.out_bias -= 0.01 * (ob[0] / (1 - 0.9**step)) / (np.sqrt(ob[1] / (1 - 0.999**step)) + 1e-8)
            for r, g in g_emb.items():
                g = g / len(batch)
                emb_sq[r] += g @ g
                p.emb[r] -= 0.05 * g / np.sqrt(emb_sq[r])
    return p


def packed(p: Params) -> np.ndarray:
    """All parameters as rows of EMBED numbers, the embeddings first."""
    rest = np.concatenate([*(f.ravel() for f in p.filters), p.bias, p.out, [p.out_bias]])
    return np.concatenate([p.emb, np.pad(rest, (0, -len(rest) % EMBED)).reshape(-1, EMBED)])


def unpacked(rows: np.ndarray, size: int) -> Params:
    """The parameters of ``packed`` rows, of which ``size`` are embeddings."""
    n_filters, n_out = sum(WIDTHS), FILTERS * len(WIDTHS)
    rest = rows[size:].ravel()
    cuts = np.cumsum([EMBED * FILTERS] * n_filters + [n_out, n_out, 1])
    *filters, bias, out, out_bias = np.split(rest, cuts)[:-1]
    return Params(rows[:size], [f.reshape(EMBED, FILTERS) for f in filters], bias, out, float(out_bias[0]))


def _best_threshold(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Of largest F1."""
    order = np.argsort(s, kind="stable")
    s, y, w = s[order], y[order], w[order]
    hits, right = (np.r_[np.cumsum(x[::-1])[::-1], 0.0] for x in (w, w * y))
    limits = np.unique(np.round(s, 3))
    at = np.searchsorted(s, limits)
    f1 = 2 * right[at] / np.maximum(hits[at] + (w * y).sum(), 1e-12)
    return float(limits[f1.argmax()])


def constant(rate: float) -> Model:
    """Where there are no rows of both labels."""
    p = min(max(rate, 0.0), 1 - 1e-9)
    shift = float(np.log(p / (1 - p))) if p > 0 else -30.0
    n_out = FILTERS * len(WIDTHS)
    return Model({}, [np.zeros((1, FILTERS), np.float32)] * sum(WIDTHS), np.zeros(n_out), np.zeros(n_out), 0.0, 1.0, shift)


def _hashes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32)


def labelled(docs: DataFrame, known: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """Every row of a labelled id: (h, aside, lang, y, ids), its whole text as hashes of its words. No text moves."""
    own = docs.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        (F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")).alias("_lang"),
    )
    kind = dict(own.dtypes)["_key"]
    known = known.select(F.col("_key").try_cast(kind).alias("_key"), "_y")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in sliced(batches):
            ids = []
            for t in b.column(1):
                words = t.as_py().split()
                if len(cache) > CACHE:
                    cache.clear()
                for w in words:
                    if w not in cache:
                        cache[w] = bucket_of(w)
                ids.append(np.fromiter(map(cache.__getitem__, words), np.int32, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary())], names=["_key", "lang", "ids"])

    hashed = sieved(own, known, ["_key"]).mapInArrow(task, f"_key {kind}, lang string, ids binary")
    aside = F.pmod(F.xxhash64("_key", F.lit("aside")), F.lit(100)) < ASIDE
    # the merge hint: hashes move at every size, so that a small table tells what a large one needs
    return hashed.join(known.hint("merge"), "_key").select(F.xxhash64("_key").alias("h"), aside.alias("aside"), "lang", F.col("_y").alias("y"), "ids")


def word_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in at least LEAST_DOCS rows, and in how many of each label they are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for y, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[y, np.unique(_hashes(ids))] += 1
        at = np.flatnonzero(seen.any(axis=0))
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, seen[0, part], seen[1, part])], names=["b", "c0", "c1"])

    counts = rows.select("y", "ids").mapInArrow(task, "b long, c0 long, c1 long").groupBy("b").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    found = counts.filter(F.col("c0") + F.col("c1") >= LEAST_DOCS).toArrow()  # at most BUCKETS rows
    b, c0, c1 = (found.column(c).to_numpy() for c in ("b", "c0", "c1"))
    order = np.argsort(b)
    return b[order], np.stack([c0[order], c1[order]])


def mixed(rows: DataFrame, log_odds: np.ndarray, lut: np.ndarray, shards: int) -> Params:
    """The mean of what each shard of the rows learns from ``start_params(log_odds)``."""
    sent = rows.sparkSession.sparkContext.broadcast((log_odds, lut))
    names = [f"v{i}" for i in range(EMBED)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, row_of = None, sent.value[1]
        for g in grouped(batches, 1):
            p = p or start_params(sent.value[0])
            docs = [padded(row_of[_hashes(x)]) for x in g.column("ids")]
            own = learn(p, docs, g.column("y").to_numpy().astype(np.float64), g.column("shard")[0].as_py())
            moved = np.rint((packed(own) - packed(p)) * UNIT).astype(np.int64)
            at = np.flatnonzero(moved.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(moved[at, i]) for i in range(EMBED))], names=["at", *names])

    dealt = rows.select(F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(shards)).alias("shard"), "h", "y", "ids")
    dealt = dealt.repartition(4 * shards, "shard").sortWithinPartitions("shard", "h", "y", "ids")
    moved = dealt.mapInArrow(task, ", ".join(f"{x} long" for x in ("at", *names))).groupBy("at").agg(*(F.sum(x).alias(x) for x in names))
    found = moved.toArrow()  # at most a row per row of parameters
    sent.destroy()
    total = packed(start_params(log_odds))
    total[found.column("at").to_numpy()] += np.stack([found.column(x).to_numpy() for x in names], axis=1) / (UNIT * shards)
    return unpacked(total, len(log_odds))


def calibrate(model: Model, rows: DataFrame, lut: np.ndarray) -> None:
    """Scale, shift and thresholds by language from the margins of all ``rows``."""
    sent = rows.sparkSession.sparkContext.broadcast((model, lut))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row_of = sent.value
        for b in batches:
            at = [round(MARGIN_STEPS * min(max(m.margin(padded(row_of[_hashes(x)])), -MARGIN_MOST), MARGIN_MOST)) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64())], names=["lang", "y", "at"])

    counted = rows.select("lang", "y", "ids").mapInArrow(task, "lang string, y int, at long").groupBy("lang", "y", "at").count()
    found = counted.toPandas().sort_values(["lang", "y", "at"])  # counts of at most 2 * MARGIN_MOST * MARGIN_STEPS steps a label and language
    sent.destroy()
    x, y, w = found["at"].to_numpy() / MARGIN_STEPS, found["y"].to_numpy(np.float64), found["count"].to_numpy(np.float64)
    model.scale, model.shift = _logistic(x, y, w)
    scores = 1 / (1 + np.exp(-np.clip(model.scale * x + model.shift, -30, 30)))
    for name in found["lang"].unique():
        own = (found["lang"] == name).to_numpy()
        if len(np.unique(y[own])) == 2:
            model.thresholds[name] = _best_threshold(scores[own], y[own], w[own])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row of an id that has a label and is not held out."""
    known = labels.select(F.col(key).alias("_key"), F.col("toxic").cast("int").alias("_y")).filter(
        F.col("_key").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_key"))
    )
    known = known.groupBy("_key").agg(F.min("_y").alias("_y"), F.max("_y").alias("most")).filter("_y = most").drop("most")
    rows = cut(labelled(docs, known, key, text, lang), "toxic-rows")
    facts = rows.groupBy("y", "aside").agg(F.count("*").alias("n"), F.sum(F.length("ids")).alias("bytes")).collect()  # four rows
    n = [sum(r["n"] for r in facts if r["y"] == v) for v in (0, 1)]
    if not all(n):
        release(rows)
        counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}  # two rows
        return constant(counts.get(1, 0) / max(1, sum(counts.values())))
    apart = len(facts) == 4  # else all rows train and calibrate
    trained = [r for r in facts if not (apart and r["aside"])]
    taught = rows.filter("not aside") if apart else rows
    buckets, counts = word_counts(taught)
    n = [sum(r["n"] for r in trained if r["y"] == v) for v in (0, 1)]
    odds = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    lut = np.zeros(BUCKETS, np.int32)
    lut[buckets] = np.arange(1, len(buckets) + 1)
    shards = max(-(-sum(n) // (STEPS * BATCH)), -(-sum(r["bytes"] for r in trained) // (4 * SHARD_WORDS)))
    p = mixed(taught, np.r_[0.0, odds], lut, shards)
    p.emb = p.emb.astype(np.float32)
    model = Model.of(dict(zip(buckets.tolist(), range(1, len(buckets) + 1), strict=True)), p)
    calibrate(model, rows.filter("aside") if apart else rows, lut)
    release(rows)
    return model


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: held_out, score, predicted, and ``flagged`` by the threshold of its language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    kind = dict(docs.select(key).dtypes)[key]
    own = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), (F.col(lang) if lang in docs.columns else F.lit("")).cast("string").alias("_lang")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        rows: dict[str, int] = {}
        for b in sliced(batches):
            scores = []
            for t in b.column(1):
                words = (t.as_py() or "").split()
                try:
                    ids = [rows[w] for w in words]
                except KeyError:
                    if len(rows) > CACHE:
                        rows.clear()
                    for w in words:
                        if w not in rows:
                            rows[w] = m.rows.get(bucket_of(w), 0)
                    ids = [rows[w] for w in words]
                scores.append(m.score(m.margin(padded(ids))))
            limits = [m.thresholds.get(x or "", THRESHOLD) for x in b.column(2).to_pylist()]
            flagged = [s >= x for s, x in zip(scores, limits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array(flagged, pa.bool_())], names=["_key", "score", "flagged"]
            )

    scored = own.mapInArrow(task, f"_key {kind}, score double, flagged boolean")
    return scored.select(
        F.col("_key").alias(key),
        F.coalesce(held_out(F.col("_key")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "flagged",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
