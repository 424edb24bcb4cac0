"""Extraction runs over many transcripts at once; what fails is a row with a status, never an exception."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, json_text_array, stable_id, strip, strip_code_fence
from ..schemas import ERROR_LIMIT, PROMPT_VERSION, TABLES
from .citation import Checker, lexical_check, resolve_support
from .contract import validate
from .prompt import INSTRUCTIONS, prompts

#: (transcript_id, conversation_id, messages, prompt, prompt_sha256) to (transcript_id, raw_output, error_message).
Extractor = Callable[[DataFrame], DataFrame]


def file_extractor(path: str) -> Extractor:
    """The text of one file for every transcript, whatever the prompt."""

    def extract(asked: DataFrame) -> DataFrame:
        file = asked.sparkSession.read.text(path, wholetext=True).select(F.col("value").alias("raw_output")).limit(1)
        text = file.first()  # one file
        return asked.select("transcript_id", F.lit(text["raw_output"] if text else None).alias("raw_output"), F.lit(None).cast("string").alias("error_message"))

    return extract


def table_extractor(outputs: DataFrame) -> Extractor:
    """Outputs that are there already: (transcript_id, raw_output)."""

    def extract(asked: DataFrame) -> DataFrame:
        found = asked.select("transcript_id").join(outputs.select("transcript_id", "raw_output"), "transcript_id", "left")
        return found.withColumn("error_message", F.when(F.col("raw_output").isNull(), "Extractor raised LookupError: no output"))

    return extract


def callable_extractor(ask: Callable[[str], str]) -> Extractor:
    """A Python function from prompt to output, run on the executors; an exception fails its run only."""

    def extract(asked: DataFrame) -> DataFrame:
        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for key, prompt in zip(f["transcript_id"], f["prompt"], strict=True):
                    try:
                        rows.append((key, ask(prompt), None))
                    except Exception as e:  # whatever a model client raises is this run's failure
                        rows.append((key, None, f"Extractor raised {type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["transcript_id", "raw_output", "error_message"])

        return asked.select("transcript_id", "prompt").mapInPandas(task, "transcript_id string, raw_output string, error_message string")

    return extract


@dataclass(frozen=True)
class ModelConfig:
    model: str
    api_key: str
    base_url: str


#: Sends a JSON body to the model that the config names; gives the response's text, or raises.
Transport = Callable[[ModelConfig, str], str]


def model_extractor(config: ModelConfig, transport: Transport, max_tokens: int = 4096) -> Extractor:
    """A model behind a transport that runs on the executors: request, response, unwrapped text; errors fail their run only."""

    def extract(asked: DataFrame) -> DataFrame:
        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for key, body in zip(f["transcript_id"], f["body"], strict=True):
                    try:
                        rows.append((key, transport(config, body), None))
                    except Exception as e:  # whatever a client raises is this run's failure
                        rows.append((key, None, f"Extractor raised {type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["transcript_id", "response", "failure"], dtype=object)

        sent = asked.select("transcript_id", completion_request(F.col("prompt"), config.model, max_tokens).alias("body"))
        sent = sent.mapInPandas(task, "transcript_id string, response string, failure string")
        told = sent.withColumn("r", unwrap_completion(F.col("response"), config.model))
        said = F.concat(F.lit("Extractor raised ModelError: "), F.col("r.error"))
        return told.select("transcript_id", F.when(F.col("failure").isNull(), F.col("r.content")).alias("raw_output"), F.coalesce("failure", said).alias("error_message"))

    return extract


def completion_request(prompt: Column, model: str, max_tokens: int = 4096) -> Column:
    """The JSON body of a chat completion with the prompt as its one message."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(max_tokens).alias("max_tokens")))


def api_error_message(body: Column) -> Column:
    """``error.message`` of a JSON body, if it is a filled string."""
    v = F.try_parse_json(body)
    text = F.try_variant_get(v, "$.error.message", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.error.message", "variant"))
    return F.when((kind == "STRING") & ~is_blank(text), text)


def unwrap_completion(response: Column, model: str) -> Column:
    """Struct (content, error) of a completion's JSON: an error object, no choices, a bad choice, a cut-off or empty
    content are errors, in this order; content loses its code fence."""
    v = F.try_parse_json(response)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
    get = lambda path: F.try_variant_get(v, path, "string")
    choices = F.try_variant_get(v, "$.choices", "array<variant>")
    content = get("$.choices[0].message.content")
    said = F.coalesce(F.nullif(get("$.error.message"), F.lit("")), F.to_json(F.try_variant_get(v, "$.error", "variant")))
    error = (
        F.when(~F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), F.lit("LLM API returned a non-JSON response body."))
        .when(kind("$.error").startswith("OBJECT"), F.concat(F.lit("LLM API returned an error: "), said))
        .when(~kind("$.choices").startswith("ARRAY") | (F.size(choices) == 0), F.lit(f"LLM API response for model '{model}' contained no choices."))
        .when(~kind("$.choices[0]").startswith("OBJECT"), F.lit("LLM API response choice must be an object."))
        .when(get("$.choices[0].finish_reason") == "length", F.lit(f"Model '{model}' output was truncated at the max_tokens limit; the extraction JSON is incomplete."))
        .when((kind("$.choices[0].message.content") != "STRING") | is_blank(F.coalesce(content, F.lit(""))), F.lit(f"LLM API response for model '{model}' contained no message content."))
    )
    return F.struct(F.when(error.isNull(), strip_code_fence(content)).alias("content"), error.alias("error"))


def run_extraction(
    transcripts: DataFrame,
    messages: DataFrame,
    blocks: DataFrame,
    extractor: Extractor,
    extractor_name: str,
    started_at: Column,
    completed_at: Column | None = None,
    model: str | None = None,
    checker: Checker = lexical_check,
    output_root: str = "extractions",
    instructions: str = INSTRUCTIONS,
) -> dict[str, DataFrame]:
    """Frames of extraction_runs, claim_ledger, claim_support_checks and extraction_outputs (with the text, as
    ``contents``) for one run per transcript."""
    completed_at = started_at if completed_at is None else completed_at
    asked = prompts(transcripts, messages, blocks, instructions)
    outputs = extractor(asked)
    answered = asked.join(outputs, "transcript_id", "left").withColumn("started_at", started_at)
    answered = answered.withColumn("run_id", stable_id("run", F.col("transcript_id"), F.lit(extractor_name), F.col("prompt_sha256"), F.col("started_at")))
    judged, claims = validate(answered.filter("error_message is null").select("run_id", "transcript_id", "raw_output"), asked)
    verdicts = judged.select("run_id", "status", F.col("error_message").alias("rejection"), "output_claim_count")
    runs = answered.join(verdicts, "run_id", "left").select(
        "run_id",
        "transcript_id",
        F.lit(extractor_name).alias("extractor_name"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        "prompt_sha256",
        F.lit(model).cast("string").alias("model"),
        F.coalesce("status", F.lit("failed")).alias("status"),
        F.left(F.coalesce("error_message", "rejection"), F.lit(ERROR_LIMIT)).alias("error_message"),
        F.size("messages").cast("long").alias("input_message_count"),
        F.coalesce("output_claim_count", F.lit(0)).cast("long").alias("output_claim_count"),
        "started_at",
        completed_at.alias("completed_at"),
        completed_at.alias("created_at"),
    )
    conversations = transcripts.select("transcript_id", "conversation_id")
    resolved = resolve_support(claims, checker=checker).join(conversations, "transcript_id")
    resolved = resolved.withColumn("claim_id", stable_id("claim", F.col("run_id"), F.col("claim_sequence"))).withColumn("created_at", completed_at)
    ledger = resolved.withColumn("concept_tags_json", json_text_array(F.col("concept_tags"))).withColumn("supersedes_claim_id", F.lit(None).cast("string"))
    checks = resolved.withColumn("check_id", stable_id("check", F.col("claim_id")))
    is_json = F.try_parse_json(F.col("raw_output")).isNotNull()
    written = answered.filter(F.col("error_message").isNull() & is_json).withColumn("contents", F.concat(strip(F.col("raw_output")), F.lit("\n")))
    written = written.select(
        "run_id",
        F.concat(F.lit(output_root + "/"), "transcript_id", F.lit("-"), "run_id", F.lit(".json")).alias("file_path"),
        F.sha2("contents", 256).alias("sha256"),
        F.octet_length("contents").cast("long").alias("byte_size"),
        completed_at.alias("created_at"),
        "contents",
    )
    columns = lambda df, t, *more: df.select(*TABLES[t].fieldNames(), *more)
    return {
        "extraction_runs": columns(runs, "extraction_runs"),
        "claim_ledger": columns(ledger, "claim_ledger"),
        "claim_support_checks": columns(checks, "claim_support_checks"),
        "extraction_outputs": columns(written, "extraction_outputs", "contents"),
    }
