"""The pipeline over a small corpus, stage by stage against plain versions."""

import os
import random

import pytest
from brute import first_kept, near, quality, secrets

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    words = ["the", "of", "and", "to"] * 10 + [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [say(r.randint(60, 160)) for _ in range(40)]
    shared = say(90)
    texts += [say(60) + " " + shared + " " + say(60) for _ in range(3)]
    texts += [texts[0], texts[1] + " more", texts[2].replace("word1", "Word1"), "too short", "### $$$ " * 60, None, ""]
    texts += [say(70) + " password: hunter2hunter2 " + say(5)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = stages[names[0]](spark, docs, "")
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(after) == {k for k, t in before.items() if not quality(t)[-1] and "#" not in t}
    assert kept.columns == docs.columns

    one = stages[names[1]](spark, kept, "")
    rows = sorted(after.items())
    left = {k for (k, _), (_, c) in zip(rows, near(rows, 5, 80), strict=True) if k == c}
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(texts) == left and one.columns == docs.columns

    cleaned = stages[names[2]](spark, one, "")
    order = sorted(texts)
    clean = {r["doc_id"]: r for r in cleaned.collect()}
    assert [clean[k]["text"] for k in order] == first_kept([(k, texts[k]) for k in order], 10**9, 51)
    assert all(len(clean[k]["text"]) == clean[k]["n_chars"] for k in order) and sum(len(t) for t in texts.values()) - sum(r["n_chars"] for r in clean.values()) > 500
    assert cleaned.columns == docs.columns

    safe = stages[names[3]](spark, cleaned, "")
    for r in safe.collect():
        assert (r["text"] == clean[r["doc_id"]]["text"]) == (not secrets(clean[r["doc_id"]]["text"]))
        assert not secrets(r["text"])
    assert safe.columns == docs.columns

    packed = stages[names[4]](spark, safe, "").collect()
    assert {p["doc_id"] for p in packed} == set(order)


def test_repeated_rows_and_missing_ids(spark):
    """One row of each group passes near-dedup, and the next stage leaves its text whole."""
    r = random.Random(14)
    twice, nameless, mixed, other = (" ".join(f"w{r.randrange(10**6)}" for _ in range(90)) for _ in range(4))
    rows = [(7, twice), (7, twice), (7, other), (None, nameless), (None, nameless + " more"), (9, mixed), (None, mixed), (8, mixed + " more")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["near_dedup"](spark, docs, "")
    assert one.columns == docs.columns
    got = [(x["doc_id"], x["text"]) for x in stages["substring_dedup"](spark, one, "").collect()]
    assert len(got) == 4 and {(7, twice), (7, other), (8, mixed + " more")} < set(got)
    assert {t for k, t in got if k is None} < {nameless, nameless + " more"}


def test_passages_of_51_words(spark):
    """Over 50 words in few bytes go but for the first, 50 words stay; words are compared whole, whatever parts them."""
    r = random.Random(12)
    own = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    small, fifty = " ".join(f"é{i}" for i in range(51)), " ".join(f"b{i}" for i in range(50))
    other = small.replace(" ", "\n", 3)
    assert len(small.encode()) < 400
    parts = [(own(60), small, own(40)), (own(40), other, own(60)), (own(40), fifty, own(60)), (own(60), fifty, own(40))]
    docs = spark.createDataFrame([(i, " ".join(p), "en", "s", 0) for i, p in enumerate(parts)], COLUMNS)
    got = {x["doc_id"]: x for x in dict(corpus_pipeline.STAGES)["substring_dedup"](spark, docs, "").collect()}
    for i, (a, b, c) in enumerate(parts):
        assert got[i]["text"] == (f"{a}  {c}" if i == 1 else f"{a} {b} {c}") and got[i]["n_chars"] == len(got[i]["text"])


def test_each_passage_stays_once(spark):
    """Of planted passages of 51 words and more, one occurrence stays, and nothing else goes."""
    r = random.Random(13)
    number = iter(range(10**6))
    own = lambda n: " ".join(f"w{next(number)}" for _ in range(n))
    shared = [own(n) for n in (51, 55, 64, 70, 90, 200)]
    texts = [f"{own(30)} {r.choice(shared)} {own(30)}" for _ in range(60)] + [f"{own(20)} {x} {own(5)} {x}" for x in shared]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    got = {x["doc_id"]: x["text"] for x in dict(corpus_pipeline.STAGES)["substring_dedup"](spark, docs, "").collect()}
    for x in shared:
        assert [i for i in range(len(texts)) if x in got[i]] == [min(i for i, t in enumerate(texts) if x in t)]
    left = " ".join(got.values()).split()
    assert len(left) == len(set(left)) and set(left) == set(" ".join(texts).split())


def test_awkward_rows_pass_every_stage(spark):
    """Nulls in every column, repeated rows and ids, one very long text, and columns of names that the stages use."""
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(["the", "of", "and"]) if i % 2 else f"w{r.randrange(10**6)}" for i in range(n))
    long, secret = say(30_000), f"{say(60)} token=abcdefgh12 {say(10)}"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, long, "en", "s", 9), (2, long, "en", "s", 9), (None, secret, None, "s", None), (3, secret, "de", "s", 5), (4, "short", None, None, 1)]
    more = "_row long, _repeat_row string, _Secret_Tkey long, _secret_spans int, _id string, _text string, n int"
    docs = spark.createDataFrame([(*x, 1, "a", 2, 3, "b", "c", 4) for x in rows], f"{COLUMNS}, {more}")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
    assert counts == [4, 2, 2, 2]
    got = {x["doc_id"]: x for x in docs.collect()}
    assert set(got) == {2, 3} and got[2]["text"] == long and got[3]["text"] == secret.replace("token=abcdefgh12", "[SECRET]")
    assert got[3]["n_chars"] == len(got[3]["text"]) and (got[3]["_row"], got[3]["_text"], got[3]["lang"]) == (1, "c", "de")
    # each stage by itself, on rows that an earlier one would have taken out
    docs = spark.createDataFrame([(*x, 1, "a", 2, 3, "b", "c", 4) for x in rows], f"{COLUMNS}, {more}")
    stages = dict(corpus_pipeline.STAGES)
    assert [stages[n](spark, docs, "").count() for n in ("near_dedup", "substring_dedup", "secret_scan")] == [5, 7, 7]
    kept = stages["substring_dedup"](spark, docs, "").collect()
    assert sorted(len(x["text"] or "") for x in kept) == sorted([0, 0, len(long), 0, 0, len(secret), 5])
    assert stages["packing"](spark, docs, "").select("doc_id").distinct().count() == 5


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 100 < out.select("doc_id").distinct().count() < 200
