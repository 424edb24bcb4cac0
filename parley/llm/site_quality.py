"""Quality classifier (operator 2): document evidence and hierarchical empirical Bayes over hosts and paths.

1. A logistic regression on ratios of the text (fit in numpy on a bounded, documented sample of labelled rows) gives each
   document its own evidence, as one projection.
2. Grouped aggregates give sums and counts per path and per host, and one row for the corpus. A host's posterior mean
   shrinks to the corpus mean, a path's to its host's, by prior weights from the between-group variances (method of
   moments), so sparse sites stay near the global prior. A document's own evidence is left out of its site's.
3. A document's score adds the site's log odds, relative to the corpus, to its own.

Texts are read once and don't move; only (row, host, path, evidence) does. The sums are aggregated before the shuffle,
and a host with a third of all rows is one row in its join with the evidence, which Spark may split by skew.

Defined results: a null or empty text has the evidence of no words; null hosts or paths are sites of their own;
without labels of both kinds all weights are 0 and all evidence and scores one half, which is kept; repeated rows are scored one by one; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, read
from .quality_rules import STOP_WORDS

#: Most labelled rows that are learned from, the first in hash order.
SAMPLE = 20_000
#: Weight of the site's relative log odds.
SITE_WEIGHT = 0.5
#: Bounds of a prior's weight, in documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0
FEATURES = ("symbols", "exclamations", "upper", "stop_words", "word_length", "repeated_words", "repeated_lines", "words")


def evidence_features(text: Column) -> Column:
    """Array of bounded numbers, in the order of FEATURES."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def made(w: Column, at: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        m = F.greatest(F.size(at), F.lit(1)).cast("double")
        capped = lambda x: F.least(x.cast("double"), F.lit(1.0))
        return F.array(
            capped(F.regexp_count(text, F.lit("[#*$%&|<>]")) / n),
            capped((F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) / n),
            capped(F.regexp_count(text, F.lit(r"\p{Lu}{2}")) / n),
            capped(F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))) / n),
            F.least(F.length(text) / n, F.lit(40.0)).cast("double") / 10,
            1.0 - F.size(F.array_distinct(w)) / n,
            1.0 - F.size(F.array_distinct(at)) / m,
            F.log1p(F.size(w).cast("double")) / 10,
        )

    return let(words, lambda w: let(lines, lambda at: made(w, at)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.02) -> list[float]:
    """Logistic regression by damped Newton steps: a weight per feature, and the intercept."""
    if len(set(y.tolist())) < 2:
        return [0.0] * (x.shape[1] + 1)
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    keep = np.eye(a.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[float]:
    """Weights from at most ``sample`` labelled ids, one text each (of smallest features); the features come to the driver,
    not the texts. Ids whose crc32(doc_id as text) mod 4 is 2, or whose labels contradict each other, are never learned
    from."""
    known = labels.select(F.col(key).alias("_key"), F.col("quality").cast("double").alias("_y"))
    known = known.filter(F.col("_key").isNotNull() & F.col("_y").isin(0.0, 1.0) & (F.crc32(F.col("_key").cast("string").cast("binary")) % 4 != 2))
    known = known.groupBy("_key").agg(F.min("_y").alias("_y"), F.max("_y").alias("most")).filter("_y = most").drop("most")
    known = known.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = own.join(F.broadcast(known), "_key").select("_key", evidence_features(F.col("_text")).alias("x"), "_y")
    rows = rows.groupBy("_key").agg(F.min("x").alias("x"), F.first("_y").alias("y")).collect()  # a row a key: at most ``sample``
    rows.sort(key=lambda r: r["_key"])
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _prior_weight(between: float | None, mean: float) -> float:
    """Documents that a prior counts for: the Beta distribution with the groups' mean and variance."""
    if not between or between <= 0:
        return MOST_PRIOR
    return float(min(max(mean * (1 - mean) / between - 1, LEAST_PRIOR), MOST_PRIOR))


def site_quality(docs: DataFrame, weights: list[float], key: str, text: str, host: Column, path: Column) -> DataFrame:
    """Per document: host, path, evidence, host and path posteriors, score and ``kept``."""
    parts = [F.get(F.col("x"), i) * w for i, w in enumerate(weights[:-1])]
    margin = sum(parts, F.lit(weights[-1]))
    own = docs.select(F.col(key).alias("_key"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), evidence_features(F.col(text)).alias("x"))
    rows = cut(own.select("_key", "host", "path", (1 / (1 + F.exp(-margin))).alias("evidence")), "site-evidence")

    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("t"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("t").alias("ht"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("ht").alias("t"), F.var_pop(F.col("ht") / F.col("hn")).alias("v")).first()  # one row
    n, mean = whole["n"] or 0, (whole["t"] or 0.0) / max(whole["n"] or 0, 1)
    both = cut(paths.join(hosts, "host"), "site-paths")  # the join with the rows can then be split by skew
    inner = both.agg(F.avg(F.pow(F.col("t") / F.col("n") - F.col("ht") / F.col("hn"), F.lit(2.0))).alias("v")).first()  # one row
    a, b = _prior_weight(whole["v"], mean), _prior_weight(inner["v"], mean)
    joined = rows.join(both, ["host", "path"])
    # without the document itself
    host_mean = (F.col("ht") - F.col("evidence") + a * mean) / (F.col("hn") - 1 + a)
    out = joined.withColumn("host_posterior", host_mean)
    out = out.withColumn("path_posterior", (F.col("t") - F.col("evidence") + b * F.col("host_posterior")) / (F.col("n") - 1 + b))
    site = _logit(F.col("path_posterior")) - _logit(F.lit(mean if n else 0.5))
    out = out.withColumn("score", 1 / (1 + F.exp(-(_logit(F.col("evidence")) + SITE_WEIGHT * site))))
    return out.select(
        F.col("_key").alias(key), "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("kept")
    )


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` stands for the host; documents of one language of it are a path."""
    docs = read(spark, sf_dir, "documents")
    weights = train(docs, read(spark, sf_dir, "labels"))
    return site_quality(docs, weights, "doc_id", "text", F.col("source"), F.col("lang"))
