"""Command line: ``python -m parley.cli check-url|init|capture|ingest|extract|run|query ...`` over a ledger folder.

``capture`` lands share URLs through a fetcher, ``ingest`` takes a folder of landed files, and ``run`` is either of them and
then ``extract`` over the new transcripts. Fetchers and model transports are functions named as ``module:function``, or given
to ``main``; none is built in, as nothing here fetches from a network. Errors end with status 1.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Mapping
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urls import share_url_gate
from .operators.citation import fallback_summary, verdict_histogram
from .operators.capture import Fetcher, land
from .operators.extract import Extractor, ModelConfig, Transport, file_extractor, model_extractor, run_extraction
from .plans import ledger as L
from .streaming.captures import append_captures

EMPTY = "No records found."


def model_config(model: str | None, env: Mapping[str, str], prefix: str = "OPENROUTER") -> ModelConfig:
    """A flag goes before the environment; there is no default model, and a key is needed."""
    name = (model or env.get(f"{prefix}_MODEL", "")).strip()
    key = env.get(f"{prefix}_API_KEY", "").strip()
    if not name or not key:
        raise ValueError("a model and an API key are needed")
    return ModelConfig(name, key, env.get(f"{prefix}_BASE_URL", "https://openrouter.ai/api/v1").rstrip("/"))


def load_dotenv(text: str, env: dict[str, str]) -> None:
    """Assignments of a .env text for names that are unset or empty."""
    for line in text.splitlines():
        name, eq, value = line.strip().partition("=")
        if eq and not name.startswith("#") and name.strip() and not env.get(name.strip()):
            env[name.strip()] = value.strip().strip("\"'")


def claim_lines(claims: DataFrame) -> DataFrame:
    """One line per claim with its pointer."""
    at = F.concat(F.lit("message "), F.col("source_message_index").cast("string"))
    block = F.when(F.col("source_block_index").isNotNull(), F.concat(F.lit("block "), F.col("source_block_index").cast("string")))
    span = F.when(F.col("source_char_start").isNotNull(), F.concat(F.lit("chars "), F.concat_ws("-", F.col("source_char_start").cast("string"), F.col("source_char_end").cast("string"))))
    head = F.concat_ws(" ", F.concat(F.lit("["), "claim_id", F.lit("]")), "speaker_role", F.concat_ws("/", "speech_act_type", "hedge_level"))
    return claims.select(F.concat(head, F.lit(": "), "standalone_claim_text", F.lit(" ("), F.concat_ws(", ", at, block, span), F.lit(")")).alias("line"))


def run_lines(runs: DataFrame) -> DataFrame:
    error = F.when(F.col("error_message").isNotNull(), F.concat(F.lit(" error="), "error_message")).otherwise("")
    return runs.select(F.concat(F.concat_ws(" ", F.concat(F.lit("["), "run_id", F.lit("]")), "transcript_id", "extractor_name", "status"), F.lit(" claims="), F.col("output_claim_count").cast("string"), error).alias("line"))


def transcript_lines(transcripts: DataFrame) -> DataFrame:
    return transcripts.select(
        F.concat(
            F.lit("["), "transcript_id", F.lit("] "), "conversation_id", F.lit(" "), F.coalesce("title", F.lit("(untitled)")),
            F.lit(" messages="), F.col("message_count").cast("string"), F.lit(" warnings="), F.col("warning_count").cast("string"),
        ).alias("line")
    )


def outcome(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Per run: status, claims, verdict counts and fallbacks."""
    checks = frames["claim_support_checks"]
    counts = verdict_histogram(checks).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("support_verdict", "n"))).alias("support_verdicts"))
    runs = frames["extraction_runs"].select("run_id", "transcript_id", "status", "output_claim_count", "error_message")
    return runs.join(counts, "run_id", "left").join(fallback_summary(checks).drop("claims"), "run_id", "left")


def show(rows: DataFrame, lines: DataFrame, as_json: bool) -> None:
    """Rows stream to the terminal a partition at a time."""
    if as_json:
        for i, r in enumerate(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            print(("[" if i == 0 else ",") + r["j"])
        print("]" if not rows.isEmpty() else "[]")
        return
    found = False
    for r in lines.toLocalIterator():
        found = True
        print(r["line"])
    if not found:
        print(EMPTY)


class Usage(ValueError):
    """What was asked for can't be done with what was given."""


def _named(name: str | None):
    """The function that ``module:function`` names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def _extractor(args: argparse.Namespace, env: Mapping[str, str], transport: Transport | None) -> tuple[Extractor, str, str | None]:
    """Extractor, its name and the model: a file of claims, or a model behind a transport."""
    if args.claims_json:
        return file_extractor(args.claims_json), args.extractor_name or "file", args.model or env.get("OPENROUTER_MODEL")
    config = model_config(args.model, env)
    transport = transport or _named(args.transport)
    if transport is None:
        raise Usage("a model needs a transport (--transport module:function)")
    return model_extractor(config, transport), args.extractor_name or "model", config.model


def _capture(spark: SparkSession, ledger: L.Ledger, args: argparse.Namespace, fetch: Fetcher | None) -> int:
    """URLs to captures; 1 if any of them failed."""
    fetch = fetch or _named(args.fetcher)
    if fetch is None:
        raise Usage("capture needs a fetcher (--fetcher module:function)")
    urls = spark.createDataFrame([(u,) for u in args.url], "url string")
    files, failed = land(urls, fetch, args.fetched_at, args.output_dir or f"{ledger.path}/landed")
    print("captured" if append_captures(ledger, files, args.batch, args.fetched_at) else "batch is there already")
    errors = failed.collect()  # a row a URL of the command line
    for r in errors:
        print(json.dumps({"url": r["url"], "error": r["error"]}, ensure_ascii=False))
    return int(bool(errors))


def _ingest(spark: SparkSession, ledger: L.Ledger, args: argparse.Namespace) -> None:
    files = spark.read.text(args.folder, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    print("ingested" if append_captures(ledger, files, args.batch, args.fetched_at) else "batch is there already")


def _extract(ledger: L.Ledger, args: argparse.Namespace, batch: str, how: tuple[Extractor, str, str | None], fetched_at: str | None = None) -> int:
    """Runs over one transcript, those of a capture time, or all; 1 if any run failed."""
    t = ledger.tables()
    transcripts = L.list_transcripts(t)
    if args.transcript:
        L.get_transcript(t, args.transcript)
        transcripts = transcripts.filter(F.col("transcript_id") == args.transcript)
    if fetched_at:
        transcripts = transcripts.filter(F.col("fetched_at") == fetched_at)
    extractor, name, model = how
    frames = run_extraction(transcripts, t["transcript_messages"], t["transcript_message_blocks"], extractor, name, F.lit(args.started_at), model=model)
    ledger.append(batch, frames)
    t = ledger.tables()
    mine = t["extraction_runs"].filter(F.col("started_at") == args.started_at)
    rows = outcome({"claim_support_checks": t["claim_support_checks"], "extraction_runs": mine})
    show(rows, rows.select(F.concat_ws(" ", "run_id", "status", F.col("output_claim_count").cast("string"), F.to_json("support_verdicts")).alias("line")), False)
    return int(not mine.filter("status = 'failed'").isEmpty())


def main(argv: list[str] | None = None, spark: SparkSession | None = None, fetch: Fetcher | None = None, transport: Transport | None = None) -> int:
    parser = argparse.ArgumentParser(prog="parley")
    parser.add_argument("--ledger", default="data/ledger")
    parser.add_argument("--env-file", default=".env")
    sub = parser.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check-url")
    check.add_argument("url")
    sub.add_parser("init")
    for name in ("capture", "ingest", "extract", "run"):
        p = sub.add_parser(name)
        p.add_argument("--batch", required=True)
        if name in ("ingest", "run"):
            p.add_argument("folder", nargs="?" if name == "run" else None)
        if name in ("capture", "run"):
            p.add_argument("--url", action="append", required=name == "capture")
            p.add_argument("--fetcher")
            p.add_argument("--output-dir")
        if name != "extract":
            p.add_argument("--fetched-at", required=True)
        if name in ("extract", "run"):
            p.add_argument("--claims-json")
            p.add_argument("--transport")
            p.add_argument("--transcript")
            p.add_argument("--extractor-name")
            p.add_argument("--model")
            p.add_argument("--started-at", required=True)
    query = sub.add_parser("query")
    query.add_argument("what", choices=("transcripts", "claims", "runs"))
    for name in ("conversation", "speaker", "speech-act", "transcript"):
        query.add_argument(f"--{name}")
    query.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    ledger = L.Ledger(spark, args.ledger)
    try:
        if args.command == "check-url":
            row = spark.range(1).select(share_url_gate(F.lit(args.url)).alias("g")).first()["g"]
            print(row["conversation_id"] or f"unsupported: {row['error']}")
            return int(row["error"] is not None)
        env = dict(os.environ)
        if Path(args.env_file).is_file():
            load_dotenv(Path(args.env_file).read_text(encoding="utf-8"), env)
        if args.command == "init":
            print("made " + (", ".join(ledger.create()) or "nothing: the tables are there"))
            return 0
        if args.command == "capture":
            return _capture(spark, ledger, args, fetch)
        if args.command == "ingest":
            _ingest(spark, ledger, args)
            return 0
        if args.command == "extract":
            return _extract(ledger, args, args.batch, _extractor(args, env, transport))
        if args.command == "run":
            if bool(args.folder) == bool(args.url):
                raise Usage("run takes a folder or URLs")
            how = _extractor(args, env, transport)  # first: without it nothing is captured
            if args.folder:
                _ingest(spark, ledger, args)
            elif _capture(spark, ledger, args, fetch):
                return 1
            return _extract(ledger, args, args.batch + "-extract", how, args.fetched_at)
        t = ledger.tables()
        if args.what == "transcripts":
            rows = L.list_transcripts(t, args.conversation)
            show(rows, transcript_lines(rows), args.json)
        elif args.what == "claims":
            rows = L.list_claims(t, args.conversation, args.speaker, args.speech_act, args.transcript)
            show(rows, claim_lines(rows), args.json)
        else:
            rows = L.list_extraction_runs(t, args.transcript)
            show(rows, run_lines(rows), args.json)
        return 0
    except (L.LedgerError, ValueError) as e:
        print(json.dumps({"error": str(e)}, ensure_ascii=False))
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
