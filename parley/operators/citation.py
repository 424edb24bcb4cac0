"""Citation support: is a claim backed by the text that it cites, and what stands in for it if not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens, is_blank, normalize_evidence, strip
from ..schemas import CHECK_METHOD

FULL, PARTIAL = 0.75, 0.40

#: (claim text, quote, source text) to a struct (verdict, quote_found, detail, method).
Checker = Callable[[Column, Column, Column], Column]


def _result(verdict: str | Column, found: bool, detail: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        lit(verdict).alias("verdict"), F.lit(found).alias("quote_found"), lit(detail).alias("detail"), F.lit(CHECK_METHOD).alias("method")
    )


def lexical_check(claim: Column, quote: Column, source: Column) -> Column:
    """The quote must stand in the source; then the share of the claim's content words found there decides."""
    source = F.coalesce(source, F.lit(""))
    tokens = content_tokens(claim)
    shared = F.size(F.array_intersect(tokens, content_tokens(source)))
    coverage = shared / F.size(tokens)
    detail = F.concat(F.format_number(coverage, 2), F.lit(" of claim content tokens appear in the source message."))
    verdict = F.when(coverage >= FULL, "yes").when(coverage >= PARTIAL, "partial").otherwise("no")
    return (
        F.when(is_blank(source), _result("unknown", False, "Source message text is unavailable, so support cannot be judged."))
        .when(
            ~F.contains(normalize_evidence(source), normalize_evidence(quote)),
            _result("no", False, "source_quote is not a verbatim span of the source message text."),
        )
        .when(F.size(tokens) == 0, _result("unknown", True, "Claim text has no content tokens to compare against the source."))
        .otherwise(_result(verdict, True, detail))
    )


def resolve_support(
    claims: DataFrame,
    claim: str = "standalone_claim_text",
    quote: str = "source_quote",
    source: str = "source_text",
    checker: Checker = lexical_check,
) -> DataFrame:
    """``claims`` with verdict, quote_found, fallback_applied, original_claim_text, detail and method; where the verdict
    is no or unknown, claim and quote become the words that are there."""
    checked = claims.withColumn("_check", checker(F.col(claim), F.col(quote), F.col(source)))
    found = F.col("_check.quote_found")
    words = F.when(found, F.col(quote)).otherwise(strip(F.coalesce(F.col(source), F.lit(""))))
    falls = F.col("_check.verdict").isin("no", "unknown") & ~is_blank(words)
    checked = checked.withColumn("_falls", falls).withColumn("_words", words)
    return (
        checked.withColumn("original_claim_text", F.when(F.col("_falls"), F.col(claim)))
        .withColumn(claim, F.when(F.col("_falls"), F.col("_words")).otherwise(F.col(claim)))
        .withColumn(quote, F.when(F.col("_falls") & ~found, F.col("_words")).otherwise(F.col(quote)))
        .withColumn("support_verdict", F.col("_check.verdict"))
        .withColumn("check_method", F.col("_check.method"))
        .withColumn("quote_found", found.cast("long"))
        .withColumn("fallback_applied", F.col("_falls").cast("long"))
        .withColumn("detail", F.col("_check.detail"))
        .drop("_check", "_falls", "_words")
    )


def verdict_histogram(checks: DataFrame) -> DataFrame:
    return checks.groupBy("run_id", "support_verdict").agg(F.count("*").alias("n"))


def fallback_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("run_id").agg(F.sum("fallback_applied").alias("fallbacks"), F.count("*").alias("claims"))
