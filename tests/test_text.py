"""Text functions against plain specifications over seeded random texts."""

import random
import re

from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions.urls import share_url_gate, snapshot_api_url
from parley.sources import snapshot as S

PIECES = ["a", "B", "é", "İ", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1e", "\x1f", "\x85", "\xa0", " ", " ", "you", "user", "0", ".", "```", "the"]


def texts(n=3000, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_evidence(spark):
    t = texts()
    assert column(spark, t, X.normalize_evidence) == [re.sub(r"\s+", " ", x).strip().lower() for x in t]


def test_content_tokens(spark):
    t = texts()
    want = [sorted({w for w in re.findall("[a-z0-9]+", x.lower()) if w not in X.STOP_WORDS}) for x in t]
    assert [sorted(x) for x in column(spark, t, X.content_tokens)] == want


def test_clean_text(spark):
    t = texts()
    assert column(spark, t, X.clean_text) == [S.clean(x) for x in t]


def test_normalize_role(spark):
    t = texts() + ["Claude said", "human", "youth", "the system.", ""]
    assert column(spark, t, X.normalize_role) == [S.role_of(x) for x in t]


def test_strip_and_blank(spark):
    t = texts()
    assert column(spark, t, X.strip) == [x.strip() for x in t]
    assert column(spark, t, X.is_blank) == [not x.strip() for x in t]


def test_code_fence(spark):
    t = ["```json\n{}\n```", "```\n{}", "{} ", "```", "```json\n{}\n``` \n", "a\n```", "```a\nb```\nc\n```"]
    assert column(spark, t, X.strip_code_fence) == ["{}", "{}", "{}", "", "{}", "a\n```", "b```\nc"]


def test_coverage_text_is_pythons(spark):
    pairs = [(n, d) for d in range(1, 120) for n in range(d + 1)]
    df = spark.createDataFrame(pairs, "n int, d int").select("n", "d", F.format_number(F.col("n") / F.col("d"), 2).alias("x"))
    assert all(r["x"] == f"{r['n'] / r['d']:.2f}" for r in df.collect())


def test_share_gate(spark):
    urls = ["https://claude.ai/share/abc", " HTTPS://WWW.Claude.ai:443//share/abc/?q#f ", "http://claude.ai/share/a", "https://x.ai/share/a", "https://claude.ai/chat/a", "https://u@claude.ai/share/a/b", "", None, "https://claude.ai/share/a;p"]
    got = [(g["conversation_id"], g["error"]) for g in column(spark, urls, share_url_gate)]
    assert got == [("abc", None), ("abc", None), (None, "scheme"), (None, "host"), (None, "path"), (None, "path"), (None, "scheme"), (None, "scheme"), ("a", None)]
    assert column(spark, ["a b/~"], snapshot_api_url)[0].split("/")[-1].startswith("a%20b%2F~?")


def test_json_text_array(spark):
    df = spark.createDataFrame([(["a", 'é"'],), ([],)], "x array<string>").select(X.json_text_array(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == ['["a", "é\\""]', "[]"]
