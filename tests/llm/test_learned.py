"""Classifiers: held-out accuracy on the test tables, and awkward inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import site_quality, toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_data
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model)
    held = got.join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    hit = held[(held.predicted == 1) & (held.toxic == 1)]
    assert len(hit) / max(1, (held.predicted == 1).sum()) > 0.8 and len(hit) / (held.toxic == 1).sum() > 0.5
    again = toxicity.train(docs, labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert again.shift == model.shift and (again.out == model.out).all()  # held-out labels change nothing


def plain_pooled(model, at):
    """Convolution and pooling with loops."""
    out, k, n = [], 0, len(at) - max(toxicity.WIDTHS) + 1
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = max(sum(float(model.tables[k + j][at[i + j], f]) for j in range(w)) for i in range(n))
            out.append(max(best + float(model.bias[len(out)]), 0.0))
        k += w
    return out


def small_params(r, words=6):
    filters = [r.normal(size=(toxicity.EMBED, toxicity.FILTERS)) for w in toxicity.WIDTHS for _ in range(w)]
    emb = r.normal(size=(words, toxicity.EMBED))
    emb[0] = 0
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    return toxicity.Params(emb, filters, r.normal(size=n), r.normal(size=n), 0.3)


def test_pooling_against_loops(monkeypatch):
    r = np.random.default_rng(1)
    for size in (3, 1 << 16):
        monkeypatch.setattr(toxicity, "SLICE", size)
        for n in (0, 1, 2, 3, 4, 17):
            p = small_params(r)
            model = toxicity.Model({}, [p.emb @ f for f in p.filters], p.bias, p.out, p.out_bias)
            at = toxicity.padded(r.integers(0, 6, n).tolist())
            assert np.allclose(model.pooled(at), plain_pooled(model, at))


def test_gradient_against_differences():
    r = np.random.default_rng(2)

    def loss(p, at, y):
        model = toxicity.Model({}, [p.emb @ f for f in p.filters], p.bias, p.out, p.out_bias)
        z = sum(a * b for a, b in zip(plain_pooled(model, at), p.out, strict=True)) + p.out_bias
        return float(np.log1p(np.exp(z)) - y * z)

    for y in (0, 1):
        p, at = small_params(r), toxicity.padded(r.integers(0, 6, 7).tolist())
        of_filters, of_bias, of_out, of_out_bias, of_emb = toxicity.example_gradient(p, at, y)
        pairs = [*zip(p.filters, of_filters, strict=True), (p.bias, of_bias), (p.out, of_out), *((p.emb[k : k + 1], g[None, :]) for k, g in of_emb.items())]
        for array, grad in pairs:
            for _ in range(6):
                i = tuple(int(r.integers(0, s)) for s in array.shape)
                keep = array[i]
                array[i] = keep + 1e-6
                up = loss(p, at, y)
                array[i] = keep - 1e-6
                down = loss(p, at, y)
                array[i] = keep
                assert abs((up - down) / 2e-6 - grad[i]) < 1e-5
        p.out_bias += 1e-6
        up = loss(p, at, y)
        p.out_bias -= 2e-6
        assert abs((up - loss(p, at, y)) / 2e-6 - of_out_bias) < 1e-5


def test_toxicity_sample(spark):
    """Contradicting labels and repeated ids change nothing from run to run, in whatever order rows come."""
    rows = [(i, f"fine words number {i}" if i % 3 else f"you vile creature {i}") for i in range(120)] + [(7, "you vile text of seven"), (7, None), (8, "x " * 6000)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(120)] + [(9, 1, 0), (10, 0, 1), (10, 0, 1)]
    made = []
    for turn in (1, -1):
        docs = frame(spark, rows[::turn])
        known = spark.createDataFrame(labels[::turn], "doc_id long, quality int, toxic int").repartition(3)
        made.append(toxicity.train(docs, known))
    assert made[0].shift == made[1].shift and made[0].rows == made[1].rows and (made[0].out == made[1].out).all()


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", None, 0.5, True) for k, t in rows], "doc_id long, text string, lang string, source string, score double, held_out boolean")


def test_toxicity_edges(spark):
    docs = frame(spark, [(i, f"fine words number {i}" if i % 3 else f"you vile creature {i}") for i in range(200)] + [(900, None), (901, ""), (901, "x " * 30_000), (None, "y")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 204 and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in got)
    assert all(g["predicted"] == int(g["doc_id"] % 3 == 0) for g in got if g["doc_id"] is not None and g["doc_id"] < 200)
    none = toxicity.score_documents(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert {g["predicted"] for g in none} == {0}
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_toxicity_learns_from_every_row(spark):
    """Words that only some of very many labelled texts hold, or very long ones, are learned."""
    ids = spark.range(6400).filter(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    rows = [(k, "you vile one" if i < 3000 else "you wretched one") for i, k in enumerate(ids[:4000])]
    rows += [(k, "fine words here") for k in ids[4000:4100]] + [(k, "fine " * 10_001 + "endless") for k in ids[4100:4110]]
    labels = spark.createDataFrame([(k, 1, int(i < 4000)) for i, k in enumerate(ids[:4110])], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows), labels)
    assert {toxicity.bucket_of(w) for w in ("vile", "wretched", "endless")} <= set(model.rows)
    asked = frame(spark, [(1, "you vile one"), (2, "you wretched one"), (3, "fine words here"), (4, "fine " * 10_001 + "endless")])
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(asked, model).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_word_counts_and_shards_against_loops(spark):
    """Counts over all rows of labelled ids, and the mean of what two shards learn."""
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(list("abcdefgh"), int(r.integers(0, 12)))) for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    known = spark.createDataFrame([(i, i % 2) for i in range(45)], "_key int, _y int")  # keys of another width
    found = toxicity.labelled(frame(spark, rows), known, "doc_id", "text", "lang").cache()
    buckets, counts = toxicity.word_counts(found)
    plain = {}
    for k, t in rows:
        for w in set(t.split()) if k < 45 else ():
            plain.setdefault(toxicity.bucket_of(w), [0, 0])[k % 2] += 1
    plain = {b: c for b, c in plain.items() if sum(c) >= toxicity.LEAST_DOCS}
    assert dict(zip(buckets.tolist(), counts.T.tolist(), strict=True)) == plain

    lut = np.zeros(toxicity.BUCKETS, np.int32)
    lut[buckets] = np.arange(1, len(buckets) + 1)
    odds = np.r_[0.0, r.normal(size=len(buckets))]
    start = toxicity.start_params(odds)
    assert all(np.array_equal(a, b) for a, b in zip(vars(toxicity.unpacked(toxicity.packed(start), len(start.emb))).values(), vars(start).values(), strict=True))
    got = toxicity.packed(toxicity.mixed(found, odds, lut, 2))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(2))).orderBy("shard", "h", "y", "ids").toPandas()
    parts = []
    for shard, g in dealt.groupby("shard"):
        docs = [toxicity.padded(lut[np.frombuffer(x, np.int32)]) for x in g["ids"]]
        parts.append(toxicity.packed(toxicity.learn(start, docs, g["y"].to_numpy(float), int(shard))))
    assert len(parts) == 2 and np.allclose(got, np.mean(parts, axis=0), atol=1e-6)


def test_best_threshold():
    r = np.random.default_rng(4)
    for _ in range(50):
        n = int(r.integers(2, 30))
        s, y, w = np.round(r.random(n), 2), (r.random(n) < 0.4).astype(float), r.integers(1, 5, n).astype(float)
        f1 = lambda t: 2 * (w * y * (s >= t)).sum() / max((w * (s >= t)).sum() + (w * y).sum(), 1e-12)
        assert f1(toxicity._best_threshold(s, y, w)) == pytest.approx(max(f1(t) for t in s))


def test_gradient_in_slices(monkeypatch):
    r = np.random.default_rng(5)
    p, at = small_params(r), toxicity.padded(r.integers(0, 6, 23).tolist())
    whole = toxicity.example_gradient(p, at, 1)
    monkeypatch.setattr(toxicity, "SLICE", 4)
    parts = toxicity.example_gradient(p, at, 1)
    assert all(np.allclose(a, b) for a, b in zip(whole[0], parts[0], strict=True)) and np.allclose(whole[1], parts[1]) and whole[4].keys() == parts[4].keys()


@needs_data
def test_site_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = site_quality.op2_site_quality(spark, SF)
    held = got.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).toPandas()
    assert (held.kept == (held.quality == 1)).mean() > 0.93
    assert held[held.quality == 1].kept.mean() > 0.97
    assert got.count() == docs.count()


def test_site_quality_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (2, "the a of"), (None, "b"), (3, "z" * 200_000)])
    zero = [0.0] * (len(site_quality.FEATURES) + 1)
    got = site_quality.site_quality(docs, zero, "doc_id", "text", F.col("source"), F.col("lang")).collect()
    assert len(got) == 5 and all(abs(g["score"] - 0.5) < 1e-9 and g["host"] == "" for g in got)
    assert site_quality.site_quality(docs.limit(0), zero, "doc_id", "text", F.col("source"), F.col("lang")).count() == 0


STOP = {"the", "a", "of"}


def plain_features(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, m = max(len(words), 1), max(len(lines), 1)
    cap = lambda x: min(x / n, 1.0)
    return [
        cap(sum(c in "#*$%&|<>" for c in t)), cap(t.count("!")), cap(len(re.findall("[A-ZÉ]{2}", t))), cap(sum(w in STOP for w in words)), min(len(t) / n, 40.0) / 10,
        1 - len(set(words)) / n, 1 - len(set(lines)) / m, np.log1p(len(words)) / 10,
    ]


def plain_sites(rows, weights):
    """{row: (evidence, host posterior, path posterior, score)} of (host, path, text) rows, with loops."""
    ev = [1 / (1 + np.exp(-(sum(a * b for a, b in zip(plain_features(t), weights, strict=False)) + weights[-1]))) for _, _, t in rows]
    mean = sum(ev) / len(ev)

    def groups(key):
        out = {}
        for r, e in zip(rows, ev, strict=True):
            out.setdefault(key(r), []).append(e)
        return out

    by_host, by_path = groups(lambda r: r[0]), groups(lambda r: r[:2])
    means = [sum(v) / len(v) for v in by_host.values()]
    between = sum((x - sum(means) / len(means)) ** 2 for x in means) / len(means)
    inner = sum((sum(v) / len(v) - sum(by_host[k[0]]) / len(by_host[k[0]])) ** 2 for k, v in by_path.items()) / len(by_path)
    weight = lambda v: min(max(mean * (1 - mean) / v - 1, 2.0), 1000.0) if v > 0 else 1000.0
    a, b = weight(between), weight(inner)
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for (h, p, _), e in zip(rows, ev, strict=True):
        hs, ps = by_host[h], by_path[h, p]
        host = (sum(hs) - e + a * mean) / (len(hs) - 1 + a)
        path = (sum(ps) - e + b * host) / (len(ps) - 1 + b)
        out.append((e, host, path, 1 / (1 + np.exp(-(logit(e) + 0.5 * (logit(path) - logit(mean)))))))
    return out


def test_site_quality_against_loops(spark, monkeypatch):
    monkeypatch.setattr(site_quality, "STOP_WORDS", sorted(STOP))
    r = np.random.default_rng(3)
    say = lambda: " ".join(r.choice(["the", "a", "of", "Word", "##", "ÉTÉ", "x!", "line\nline", "\n", "rare", "%1"], r.integers(0, 30)))
    rows = [("big", f"p{r.integers(0, 3)}", say()) for _ in range(60)] + [(f"h{i % 7}", f"p{i % 2}", say()) for i in range(20)] + [("", "", ""), ("one", "", "the end")]
    rows += [rows[5]] * 3
    for weights in ([-3.0, 1.0, 0.5, 2.0, 0.3, -1.0, 0.2, 0.7, 0.1], [0.0] * 9):
        docs = spark.createDataFrame([(i, h or None, p or None, t or None, 0.1, 5) for i, (h, p, t) in enumerate(rows)], "doc_id long, source string, lang string, text string, x double, n int")
        got = {g["doc_id"]: g for g in site_quality.site_quality(docs, weights, "doc_id", "text", F.col("source"), F.col("lang")).collect()}
        for i, want in enumerate(plain_sites(rows, weights)):
            assert np.allclose([got[i][c] for c in ("evidence", "host_posterior", "path_posterior", "score")], want)
            assert got[i]["kept"] == (got[i]["score"] >= 0.5) and (any(weights) or got[i]["kept"])  # a tie is kept


def test_site_quality_sample(spark):
    docs = frame(spark, [(i, "good words of the town " * 9 if i % 2 else "## $$ !! ZZ " * 9) for i in range(60)] + [(3, "## other"), (3, None)])
    labels = [(i, i % 2, 0) for i in range(60)] + [(5, 0, 0), (6, 0, 0), (7, None, 0), (None, 1, 0)]
    made = [site_quality.train(docs.orderBy(F.desc("doc_id")) if turn < 0 else docs, spark.createDataFrame(labels[::turn], "doc_id long, quality int, toxic int")) for turn in (1, -1)]
    assert np.allclose(made[0], made[1]) and any(made[0])
    assert site_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == [0.0] * 9


def test_sparse_sites_stay_near_the_prior(spark):
    """With the same evidence everywhere but for the site, large sites move a score more than small ones."""
    bad, good = "## $$ !! " * 20, "the of and to in is that it for was " * 4
    rows = [(i, "big", bad if i % 10 else good) for i in range(300)] + [(1000, "small", good)] + [(2000 + i, f"s{i % 40}", good) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    w = [0.0] * (len(site_quality.FEATURES) + 1)
    w[0], w[-1] = -4.0, 2.0
    got = {g["doc_id"]: g for g in site_quality.site_quality(docs, w, "doc_id", "text", F.col("source"), F.lit("p")).collect()}
    assert got[0]["path_posterior"] < got[1000]["path_posterior"] and got[0]["score"] < got[1000]["score"]
    assert abs(got[1000]["path_posterior"] - got[2000]["path_posterior"]) < 0.2
