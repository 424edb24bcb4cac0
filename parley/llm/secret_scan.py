"""Secret scans (operator 3): a trigram inverted index in front of the regexes.

Each regex is analysed into a Boolean query over trigrams (an OR of ANDs; texts that lack it can't match). The index
holds postings (trigram, text key) of the trigrams that the queries name; postings are intersected per clause, and only
candidate texts are verified with the regex. Rules without mandatory trigrams scan fully.

Native: DataFrame and SQL functions only. Postings of one text come from one row, so the partial aggregates leave one
row per text and clause before any shuffle. A text's key is a 64-bit hash of its content: copies share postings (a hot
copy costs no more than one text), and two texts of one key would merely share candidates, never results. The join of
the texts with their candidates is an outer join whose large side Spark may split by skew or, if the candidates are
proven small at run time, leave unshuffled.

Places are running sums in pieces, and texts are cut by bytes, so a text of n matches costs about n ** 1.5, not n ** 2.

Defined results: a null or empty text has no spans, zero counts and the hash of the empty string (``redact`` leaves it as
it is); a text that is one secret becomes the mark; repeated rows and keys are judged one by one; an empty table gives an
empty table. ``secret_digest`` reads the key and the text only; ``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, read, running, spare

#: Strings that an exact set may hold before it is turned into trigrams.
EXACT_LIMIT = 32
CLASS_LIMIT = 4


@dataclass(frozen=True)
class SecretRule:
    """``group`` and ``least``: matches whose group (0: all) has fewer characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules. Inline flags cover the keyword only.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further public token formats.
MORE_RULES = (
    SecretRule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<s:int,o:int,e:int>>"
Clauses = frozenset  # of frozensets of trigrams; an empty clause holds for every text


def _least(clauses: set[frozenset[str]]) -> Clauses:
    """Without clauses that another one implies."""
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _all(a: Clauses, b: Clauses) -> Clauses:
    return _least({x | y for x in a for y in b})


def _of(strings: set[str]) -> Clauses:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _walk(parsed) -> tuple[set[str] | None, Clauses]:
    """The exact set of strings that a piece of a regex matches, or None, and what its matches must hold."""
    exact: set[str] = {""}
    need: Clauses = frozenset({frozenset()})
    whole = True
    for op, arg in parsed:
        sub: set[str] | None = None
        must: Clauses = frozenset({frozenset()})
        if op is sre.LITERAL:
            sub = {chr(arg).lower()}
        elif op is sre.IN:
            codes = [a for o, a in arg if o is sre.LITERAL]
            if len(codes) == len(arg) <= CLASS_LIMIT:
                sub = {chr(c).lower() for c in codes}
        elif op is sre.SUBPATTERN:
            sub, must = _walk(arg[-1])
        elif op is sre.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(p[0] is not None for p in parts):
                sub = set().union(*(p[0] for p in parts))
            must = _least({c for p in parts for c in p[1]})
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner, inner_must = _walk(body)
            if inner is not None and high == 1:
                sub = inner | ({""} if low == 0 else set())
            elif inner is not None and low == high and len(inner) == 1:
                sub = {next(iter(inner)) * low}
            if low >= 1:
                must = inner_must
        if sub is not None and len(sub) * len(exact) <= EXACT_LIMIT:
            exact = {a + b for a, b in product(exact, sub)}
            continue
        need = _all(need, _of(exact))
        exact = {""}
        if sub is not None:
            exact = set(sub) if len(sub) <= EXACT_LIMIT else {""}
        need = _all(need, must)
        whole = False
    if whole:
        return exact, _of(exact)
    return None, _all(need, _of(exact))


def trigram_query(pattern: str) -> list[list[str]]:
    """An OR of ANDs of lower-case trigrams that every match's text holds; empty: the rule has no mandatory trigrams."""
    _, clauses = _walk(sre_parser.parse(pattern))
    if any(not c for c in clauses):
        return []
    return sorted(sorted(c) for c in clauses)


def spans(text: Column, rule: SecretRule, order: int, measure: Callable[[Column], Column] = F.length) -> Column:
    """Array of (s, o, e): start, ``order`` and end of the rule's leftmost non-overlapping matches, in code points, or in
    what else ``measure`` counts.

    The pieces between matches and the matches alternate, so running sums of their sizes are the places.
    """
    lit = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, lit, F.lit(0))
    body = F.regexp_extract_all(text, lit, F.lit(rule.group)) if rule.group else found
    none = F.array().cast(SPANS)

    def placed(v: Column) -> Column:
        sums = running(F.transform(v["sizes"], lambda x, i: x + F.get(v["gaps"], i)), F.lit(0), lambda a, b: a + b)

        def span(at: Column) -> Column:
            def one(size: Column, i: Column) -> Column:
                start = F.get(at, i) + F.get(v["gaps"], i)
                return F.when(F.get(v["bodies"], i) >= rule.least, F.struct(start.alias("s"), F.lit(order).alias("o"), (start + size).alias("e")))

            return F.array_compact(F.transform(v["sizes"], one))

        return let(sums, span)

    sized = F.struct(
        F.transform(F.split(text, rule.pattern, -1), measure).alias("gaps"), F.transform(found, measure).alias("sizes"), F.transform(body, F.length).alias("bodies")
    )
    return F.when(F.size(found) == 0, none).otherwise(let(sized, placed))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: (trigram, tkey), each pair once, of the trigrams asked for."""
    low = docs.select(text_key(F.col(text)).alias("tkey"), F.lower(F.col(text)).alias("low"))
    there = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("tkey", F.explode(there).alias("trigram")).groupBy("tkey", "trigram").agg(F.lit(1).alias("one")).drop("one")


def candidates(docs: DataFrame, rules: tuple[SecretRule, ...], text: str = "text") -> DataFrame:
    """(tkey, kinds): per text key the rules whose trigram query holds: postings intersected clause by clause."""
    spark = docs.sparkSession
    rows = [
        (r.kind, f"{r.kind}{i}", len(c), t) for r in rules for i, c in enumerate(trigram_query(r.pattern)) for t in c
    ]
    if not rows:
        return spark.createDataFrame([], "tkey long, kinds array<string>")
    clauses = spark.createDataFrame(rows, "kind string, clause string, n_clause int, trigram string")
    index = postings(docs, sorted({r[-1] for r in rows}), text)
    met = index.join(F.broadcast(clauses), "trigram")  # clauses: bounded by the rule list
    met = met.groupBy("tkey", "kind", "clause", "n_clause").count().filter(F.col("count") == F.col("n_clause"))
    return met.groupBy("tkey").agg(F.collect_set("kind").alias("kinds"))


def secret_spans(
    docs: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES, out: str = "secret_spans", measure: Callable[[Column], Column] = F.length
) -> DataFrame:
    """``docs`` with the column ``out``: array of (s, o, e) by start, then rule order; places in code points."""
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    tkey, kinds = spare(docs, "_secret_tkey"), spare(docs, "_secret_kinds")
    # written first: the join's large side can then be split where very many texts are the same
    found = cut(candidates(docs, indexed, text), "secret-candidates").withColumnsRenamed({"tkey": tkey, "kinds": kinds})
    joined = docs.join(found, text_key(F.col(text)) == F.col(tkey), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPANS)
    parts = []
    for o, r in enumerate(rules):
        if r in indexed:
            may = F.coalesce(F.array_contains(F.col(kinds), r.kind), F.lit(False))
            parts.append(F.when(may, spans(whole, r, o, measure)).otherwise(none))
        else:
            parts.append(spans(whole, r, o, measure))
    return joined.withColumn(out, F.array_sort(F.concat(*parts))).drop(tkey, kinds)


def redact(docs: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret replaced; overlapping spans count as one. Rows and columns stay as they are.

    Places are bytes here, so that a piece of a long text is cut without a walk from its start.
    """
    column = spare(docs, "_secret_spans")
    found = secret_spans(docs, text, rules, column, F.octet_length)

    def kept(v: Column) -> Column:
        """The pieces between the spans; ``ends``: how far the spans before each one reach."""

        def pieces(ends: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                at = F.get(ends, i)
                return F.when(x["s"] >= at, F.substring(v["data"], at + 1, x["s"] - at).cast("string"))

            last = F.get(ends, F.size(v["spans"]))
            tail = F.substring(v["data"], last + 1, F.octet_length(v["data"]) - last).cast("string")
            return F.concat(F.array_compact(F.transform(v["spans"], piece)), F.array(tail))

        return let(running(F.transform(v["spans"], lambda x: x["e"]), F.lit(0), F.greatest), pieces)

    both = F.struct(F.col(column).alias("spans"), F.col(text).cast("binary").alias("data"))
    clean = F.when(F.size(column) == 0, F.col(text)).otherwise(F.array_join(let(both, kept), mark))
    return found.withColumn(text, clean).drop(column)


def secret_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, hash of the base spans, and all spans as text."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = secret_spans(slim, "_text", rules)
    names = F.array(*[F.lit(r.kind) for r in rules])

    def said(x: Column) -> Column:
        return F.concat_ws(":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))

    base = [i for i, r in enumerate(rules) if r in BASE_RULES]
    spans_of = F.col("secret_spans")
    count = lambda kind: next(
        (F.size(F.filter(spans_of, lambda x: x["o"] == i)).cast("long") for i, r in enumerate(rules) if r.kind == kind), F.lit(0).cast("long")
    )
    return found.select(
        F.col("_key").alias(key),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter(spans_of, lambda x: x["o"].isin(base)), said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans_of, said), ",").alias("spans"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read(spark, sf_dir, "documents"))
