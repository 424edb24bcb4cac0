"""Quality rules (operator 9): a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text, so the plan is a scan and one projection: no shuffle, no
user function, memory bounded by one row. Defined results: a null or empty text has no words, so all counts are 0 and
it fails the base rule; repeated rows are judged one by one; an empty table gives an empty table; only ``text`` and the
key are read, so other columns (whatever their names) don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, let, read

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in is that it for was be are as at by on or this with
de la et les des que en un une le qui par pour dans du est au
der die das den nicht von zu und ein mit sich auf für im dem
el los y a se con las del al lo su una no
""".split()

#: Words up to this number can be packed with a hash into one long.
PACKED_WORDS = 1 << 24


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if ``measure`` is below ``low`` or above ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("too_many_symbols", "symbols_per_word", high=0.3),
    Rule("shouting", "exclamations_per_word", high=0.3),
    Rule("word_length", "mean_word_length", low=1.5, high=25.0),
    Rule("few_stop_words", "stop_word_ratio", low=0.01),
    Rule("repeated_lines", "dup_line_ratio", high=0.6),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in the text.

    Windows are hashed, packed with their place into one long and sorted as primitives; neighbours of equal hash are
    compared word by word. Where windows of one packed hash differ, equal ones may stand apart: those beside another
    window are compared as windows. Texts of more words than a packed place can hold take the windows themselves.
    """
    places = (1 << 24) - 1

    def window(i: Column) -> Column:
        return F.array(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(F.shiftright(h, 24), 24).bitwiseOR(i.cast("long"))

    def same(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(F.lit(places)).cast("int"), b.bitwiseAND(F.lit(places)).cast("int")
        return F.coalesce(F.when(close(a, b), window(i) == window(j)), F.lit(False))

    def close(a: Column, b: Column) -> Column:
        return F.shiftright(a, 24) == F.shiftright(b, 24)

    def apart(a: Column, b: Column) -> Column:
        return F.coalesce(close(a, b), F.lit(False)) & ~same(a, b)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(places))

    def short(keys: Column) -> Column:
        hits = F.transform(F.filter(keys, lambda x, i: same(x, F.get(keys, i - 1)) | same(x, F.get(keys, i + 1))), place)
        # each stretch of equal windows in a run of one packed hash has its first or last here, if the run has others
        mixed = F.filter(keys, lambda x, i: apart(x, F.get(keys, i - 1)) | apart(x, F.get(keys, i + 1)))
        both = lambda h, m: F.when(F.size(m) > 0, F.array_union(h, let(windows_of(m), equal))).otherwise(h)
        return let(hits, lambda h: let(mixed, lambda m: let(F.sort_array(both(h, m)), covered)))

    def windows_of(keys: Column) -> Column:
        return F.sort_array(F.transform(keys, lambda x: F.struct(window(place(x).cast("int")).alias("w"), place(x).alias("i"))))

    def equal(keys: Column) -> Column:
        hit = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
        hits = F.filter(keys, lambda x, i: hit(x, F.get(keys, i - 1)) | hit(x, F.get(keys, i + 1)))
        return F.transform(hits, lambda x: x["i"].cast("long"))

    def long(keys: Column) -> Column:
        return let(F.sort_array(equal(keys)), covered)

    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    return (
        F.when(n < 4, F.lit(0).cast("long"))
        .when(n < PACKED_WORDS, let(F.sort_array(F.transform(starts, packed)), short))
        .otherwise(let(F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("w"), i.alias("i")))), long))
    )


def measures(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct: the counts, ``base_failed``, ``failed`` (names of failed rules, comma-joined) and ``kept``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def verdict(m: Column) -> Column:
        n = F.greatest(m["n_words"], F.lit(1)).cast("double")
        ratio = {
            "symbols_per_word": m["n_symbols"] / n,
            "exclamations_per_word": m["n_exclamations"] / n,
            "mean_word_length": m["word_chars"] / n,
            "stop_word_ratio": m["n_stop_words"] / n,
            "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)).cast("double"),
        }
        checks = []
        for r in rules:
            x = ratio[r.measure]
            bad = F.lit(False)
            if r.low is not None:
                bad = bad | (x < r.low)
            if r.high is not None:
                bad = bad | (x > r.high)
            checks.append(F.when(bad, F.lit(r.name)))
        failed = F.array_join(F.array_compact(F.array(*checks)), ",") if checks else F.lit("")
        base = (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
        return let(
            F.struct(base.alias("base"), failed.alias("failed")),
            lambda v: F.struct(
                *[m[c].alias(c) for c in COUNTS],
                v["base"].alias("base_failed"),
                v["failed"].alias("failed"),
                (~v["base"] & (v["failed"] == "")).alias("kept"),
            ),
        )

    def counted(words: Column, at: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
            (F.size(at) - F.size(F.array_distinct(at))).cast("long").alias("n_dup_lines"),
            F.size(at).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(words).alias("n_repeat_words"),
        )

    words = F.array_remove(F.split(text, GAP), "")
    return let(words, lambda w: let(lines, lambda at: let(counted(w, at), verdict)))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every document."""
    found = docs.select(F.col(key), measures(F.col(text), rules).alias("m"))
    return found.select(key, *[F.col(f"m.{c}").alias(c) for c in (*COUNTS, "base_failed", "kept", "failed")])


def keep_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.filter(measures(F.col(text), rules)["kept"])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, [words[i], words[i + 1], words[i + 2]] AS tri
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             len(regexp_extract_all(text, '!')) AS n_exc,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             len(list_filter(words, lambda x: x IN ({_STOP_SQL}))) AS n_stop,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             greatest(len(words), 1) AS n
      FROM w LEFT JOIN r USING (rid)),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             array_to_string(list_filter([
               CASE WHEN CAST(n_symbols AS DOUBLE) / n > 0.3 THEN 'too_many_symbols' END,
               CASE WHEN CAST(n_exc AS DOUBLE) / n > 0.3 THEN 'shouting' END,
               CASE WHEN CAST(word_chars AS DOUBLE) / n < 1.5 OR CAST(word_chars AS DOUBLE) / n > 25.0 THEN 'word_length' END,
               CASE WHEN CAST(n_stop AS DOUBLE) / n < 0.01 THEN 'few_stop_words' END,
               CASE WHEN CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) > 0.6 THEN 'repeated_lines' END
             ], lambda x: x IS NOT NULL), ',') AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND failed = '') AS kept, failed FROM v
"""
