"""URL filters (operator 6): rules on hosts and paths, and a logistic regression on hashed character n-grams.

Native: scoring is one projection of built-in functions; training is one fold (``aggregate``) of gradient steps over a
small labelled table (``url_labels.tsv``, of which a quarter is held out), and what returns to the driver is at most
``DIMS`` weights, whatever the input. No shuffle of pages. The labelled table and the rule list are parameters of bounded
size.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and gets the model's
verdict on empty text; repeated rows are judged one by one; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: Buckets of the hashed n-grams, a power of two.
DIMS = 1 << 12
GRAM = 4
#: Steps over the whole labelled table, their size, and what weights lose in each.
STEPS = 250
RATE = 6.0
DECAY = 1e-4
LABELS = Path(__file__).with_name("url_labels.tsv")


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host, then a path prefix; it fits the host and its subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: The rules that the query applies.
RULES = (
    UrlRule("block", "com/en/"),
    UrlRule("allow", "example.com/en/7"),
    UrlRule("allow", "net/de/"),
    UrlRule("block", "example.net/de/8"),
    UrlRule("block", "org/es/"),
)


def labelled_urls(spark: SparkSession, part: str = "learn") -> DataFrame:
    """Rows of the small labelled table: (host, path, label), label 1 to block."""
    lines = [x.split("\t") for x in LABELS.read_text(encoding="utf-8").splitlines() if not x.startswith("#")]
    rows = [(int(label), url) for label, of, url in lines[1:] if of == part]
    host, path = split_url(F.col("url"))
    return spark.createDataFrame(rows, "label int, url string").select(host.alias("host"), path.alias("path"), "label")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), upper, lower), F.regexp_extract(url, pattern, 2)


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of ``^host$`` and of ``^path$``, hashed apart."""

    def grams(text: Column, mark: str) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

        def hashed(c: Column) -> Column:
            at = F.sequence(F.lit(0), F.greatest(F.size(c) - GRAM, F.lit(0)))
            parts = lambda i: [F.coalesce(F.get(c, i + k), F.lit("")) for k in range(GRAM)]
            return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), *parts(i)), F.lit(DIMS)).cast("int"))

        return let(chars, hashed)

    return F.array_distinct(F.concat(grams(host, "h"), grams(path, "p")))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _margin(weights: Column, bias: Column, at: Column) -> Column:
    """Sum of the weights in ``at``, over the root of their number, and the bias."""
    total = F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(weights, i))
    return total / F.sqrt(F.greatest(F.size(at), F.lit(1)).cast("double")) + bias


def train(spark: SparkSession, urls: DataFrame | None = None, steps: int = STEPS) -> list[float]:
    """A weight per bucket, then the bias, by gradient steps over the whole labelled table (bounded; ordered by content).

    The table becomes one row: which buckets a url holds, and which urls a bucket is in, so a step costs their number.
    """
    urls = labelled_urls(spark) if urls is None else urls
    rows = urls.select(
        F.xxhash64("host", "path").alias("o"), buckets(F.col("host"), F.col("path")).alias("at"), F.col("label").cast("double").alias("y")
    )
    table = rows.agg(F.array_sort(F.collect_list(F.struct("o", "at", "y"))).alias("t"))
    n = lambda t: F.greatest(F.size(t), F.lit(1))

    def solved(t: Column) -> Column:
        return let(F.array_sort(F.array_distinct(F.flatten(F.transform(t, lambda x: x["at"])))), lambda names: let(mapped(t, names), lambda m: fold(t, names, m)))

    def mapped(t: Column, names: Column) -> Column:
        held = F.transform(t, lambda x: F.transform(x["at"], lambda k: (F.array_position(names, k) - 1).cast("int")))
        places = F.transform(t, lambda x, i: F.struct(x["at"].alias("at"), i.alias("i")))
        inside = F.transform(names, lambda k: F.transform(F.filter(places, lambda p: F.array_contains(p["at"], k)), lambda p: p["i"]))
        return F.struct(held.alias("held"), inside.alias("inside"))

    def fold(t: Column, names: Column, m: Column) -> Column:
        def step(w: Column, _: Column) -> Column:
            errors = F.transform(m["held"], lambda at, i: F.get(t, i)["y"] - _sigmoid(_margin(w["w"], w["bias"], at)))
            return let(errors, lambda e: moved(w, e))

        def moved(w: Column, e: Column) -> Column:
            pull = F.transform(e, lambda g, i: g / F.sqrt(F.greatest(F.size(F.get(m["held"], i)), F.lit(1)).cast("double")) / n(t))
            weights = lambda v: F.transform(
                w["w"], lambda x, k: x * (1 - DECAY) + RATE * F.aggregate(F.get(m["inside"], k), F.lit(0.0), lambda a, i: a + F.get(v, i))
            )
            mean = F.aggregate(e, F.lit(0.0), lambda a, g: a + g) / n(t)
            return F.struct(let(pull, weights).alias("w"), (w["bias"] + RATE * mean).alias("bias"))

        start = F.struct(F.transform(names, lambda _: F.lit(0.0)).alias("w"), F.lit(0.0).alias("bias"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda w: F.struct(names.alias("names"), w["w"].alias("w"), w["bias"].alias("bias")))

    found = table.select(let(F.col("t"), solved).alias("r")).first()["r"]
    out = [0.0] * DIMS + [found["bias"]]
    for name, w in zip(found["names"], found["w"], strict=True):
        out[name] = w
    return out


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Struct of the longest fitting rule's pattern and verdict, or null. Ties go to the rule listed first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.pattern)):  # the last wrapped is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_filter(
    pages: DataFrame, weights: list[float], key: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES
) -> DataFrame:
    """Per page: host, path, rule, verdict, and the model's probability of block."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    host, path = split_url(F.col(url))
    found = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    found = found.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    p = _sigmoid(let(buckets(F.col("host"), F.col("path")), lambda at: _margin(table, F.lit(weights[DIMS]), at)))
    found = found.withColumn("p_block", p)
    method = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return found.select(
        key, "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict"), "p_block"
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"), train(spark))
