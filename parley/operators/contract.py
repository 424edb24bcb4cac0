"""The closed contract of extraction output: rules over VARIANT, each violation a row of text.

A run whose payload breaks any rule is rejected as a whole. Rules keep their order, and a rule that ends a claim's
judgement is the guard of those after it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..schemas import HEDGE_LEVELS, SPEAKER_ROLES, SPEECH_ACT_TYPES

# Fixed values of the contract.
REQUIRED = ("hedge_level", "source_message_index", "source_quote", "speaker_role", "speech_act_type", "standalone_claim_text")
OPTIONAL = ("concept_tags", "source_block_index", "source_char_end", "source_char_start", "speaker_label")


_DECODED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("text", T.StringType())])


@F.pandas_udf(_DECODED)
def strict_json(outputs: pd.Series) -> pd.DataFrame:
    """What the standard decoder says of each output; its text again in a form that VARIANT takes (last key wins)."""
    rows = []
    for text in outputs:
        try:
            value = json.loads(text if text is not None else "")
        except ValueError as e:
            rows.append((False, f"Output is not valid JSON: {e}", None))
            continue
        if not isinstance(value, dict):
            rows.append((False, "Output JSON must be an object.", None))
        else:
            rows.append((True, None, json.dumps(value, ensure_ascii=False)))
    return pd.DataFrame(rows, columns=["ok", "error", "text"])


def kind_of(v: Column) -> Column:
    """absent, null, bool, int, number, string, array or object."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "absent")
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "bool")
        .when(s == "BIGINT", "int")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _shown(v: Column, kind: Column) -> Column:
    """How a value reads in a message: quoted strings, True, False and None, else its JSON."""
    text = F.try_variant_get(v, "$", "string")
    quote = F.when(text.contains("'") & ~text.contains('"'), '"').otherwise("'")
    return (
        F.when(kind == "string", F.concat(quote, F.regexp_replace(text, r"\\", r"\\\\"), quote))
        .when(kind == "bool", F.initcap(F.to_json(v)))
        .when(kind == "null", "None")
        .otherwise(F.to_json(v))
    )


def _listed(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(names), lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def payload_errors(payload: Column, text: Column) -> Column:
    """Violations at the top: keys other than claims, and claims that are no list."""
    extra = F.filter(F.json_object_keys(text), lambda k: k != "claims")
    return F.array_compact(
        F.array(
            F.when(F.size(extra) > 0, F.concat(F.lit("Unexpected top-level keys: "), _listed(F.array_distinct(extra)))),
            F.when(kind_of(F.try_variant_get(payload, "$.claims", "variant")) != "array", F.lit('Output must contain a "claims" list.')),
        )
    )


def explode_claims(outputs: DataFrame) -> DataFrame:
    """(transcript_id, run_id, claim_sequence, claim: variant) of the outputs (…, payload) whose claims are a list."""
    claims = F.try_variant_get(F.col("payload"), "$.claims", "array<variant>")
    return outputs.select("run_id", "transcript_id", F.posexplode(claims).alias("claim_sequence", "claim"))


INTEGERS = ("source_message_index", "source_block_index", "source_char_start", "source_char_end")


def with_fields(claims: DataFrame) -> DataFrame:
    """Adds each field's value, kind and typed value as columns, so that the rules read them once however often they
    ask."""
    c = F.col("claim")
    out = claims.withColumns({f"_v_{f}": F.try_variant_get(c, f"$.{f}", "variant") for f in (*REQUIRED, *OPTIONAL)})
    more = {f"_k_{f}": kind_of(F.col(f"_v_{f}")) for f in (*REQUIRED, *OPTIONAL)}
    more |= {f"_t_{f}": F.try_variant_get(F.col(f"_v_{f}"), "$", "string") for f in (*REQUIRED, *OPTIONAL) if f not in INTEGERS}
    more |= {f"_n_{f}": F.try_variant_get(F.col(f"_v_{f}"), "$", "bigint") for f in INTEGERS}
    more |= {"_keys": F.json_object_keys(F.to_json(c)), "_k": kind_of(c)}
    return out.withColumns(more)


def claim_errors(label: Column, message: Column) -> Column:
    """Violations of one claim, over ``with_fields``. ``message``: struct (index, role, text, blocks), or null if it isn't in
    the transcript."""
    v = {f: F.col(f"_v_{f}") for f in (*REQUIRED, *OPTIONAL)}
    kind = {f: F.col(f"_k_{f}") for f in v}
    text = {f: F.col(f"_t_{f}") for f in v if f not in INTEGERS}
    number = {f: F.col(f"_n_{f}") for f in INTEGERS}
    none = lambda f: kind[f].isin("absent", "null")
    say = lambda *parts: F.concat(label, F.lit(": "), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    keys = F.col("_keys")
    is_object = F.col("_k") == "object"
    extra = F.array_except(keys, F.array(*map(F.lit, (*REQUIRED, *OPTIONAL))))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    complete = is_object & (F.size(missing) == 0)

    def enum(field: str, values: tuple[str, ...]) -> Column:
        ok = (kind[field] == "string") & text[field].isin(*values)
        return F.when(complete & ~F.coalesce(ok, F.lit(False)), say(f"invalid {field} ", _shown(v[field], kind[field]), "."))

    def filled(field: str) -> Column:
        ok = (kind[field] == "string") & ~is_blank(text[field])
        return F.when(complete & ~F.coalesce(ok, F.lit(False)), say(f"{field} must be a non-empty string."))

    at_kind = kind["source_message_index"]
    placed = complete & (at_kind == "int")
    found = placed & message.isNotNull()
    index = number["source_message_index"].cast("string")
    role_known = F.coalesce((kind["speaker_role"] == "string") & text["speaker_role"].isin(*SPEAKER_ROLES), F.lit(False))

    b_kind, b = kind["source_block_index"], number["source_block_index"]
    in_range = F.coalesce((b_kind == "int") & (b >= 0) & (b < F.size(message["blocks"])), F.lit(False))
    span = F.when(in_range, F.get(message["blocks"], b.cast("int"))["text"]).otherwise(message["text"])
    start, end = number["source_char_start"], number["source_char_end"]
    no_start, no_end = none("source_char_start"), none("source_char_end")
    given = found & ~no_start & ~no_end
    ints = (kind["source_char_start"] == "int") & (kind["source_char_end"] == "int")
    fits = (start >= 0) & (start < end) & (end <= F.length(span))
    exact = F.coalesce((kind["source_quote"] == "string") & (F.substring(span, start.cast("int") + 1, (end - start).cast("int")) == text["source_quote"]), F.lit(False))

    tags = F.try_variant_get(v["concept_tags"], "$", "array<variant>")
    tags_ok = none("concept_tags") | (
        (kind["concept_tags"] == "array")
        & F.forall(F.coalesce(tags, F.array().cast("array<variant>")), lambda t: (kind_of(t) == "string") & ~is_blank(F.coalesce(F.try_variant_get(t, "$", "string"), F.lit(""))))
    )
    label_ok = none("speaker_label") | ((kind["speaker_label"] == "string") & ~is_blank(F.coalesce(text["speaker_label"], F.lit(""))))
    return F.array_compact(
        F.array(
            F.when(~is_object, say("claim must be a JSON object.")),
            F.when(is_object & (F.size(extra) > 0), say("unexpected fields ", _listed(extra))),
            F.when(is_object & (F.size(missing) > 0), say("missing required fields ", _listed(missing))),
            filled("standalone_claim_text"),
            filled("source_quote"),
            enum("speaker_role", SPEAKER_ROLES),
            enum("speech_act_type", SPEECH_ACT_TYPES),
            enum("hedge_level", HEDGE_LEVELS),
            F.when(complete & (at_kind != "int"), say("source_message_index must be an integer.")),
            F.when(placed & message.isNull(), say("source_message_index ", index, " is not in the transcript.")),
            F.when(
                found & role_known & (message["role"] != "unknown") & (text["speaker_role"] != message["role"]),
                say("speaker_role '", text["speaker_role"], "' does not match source message role '", message["role"], "'."),
            ),
            F.when(found & ~none("source_block_index") & (b_kind != "int"), say("source_block_index must be an integer.")),
            F.when(found & (b_kind == "int") & ~in_range, say("source_block_index ", b.cast("string"), " is not in message ", index, ".")),
            F.when(found & (no_start != no_end), say("source_char_start and source_char_end must be provided together.")),
            F.when(given & ~ints, say("character offsets must be integers."))
            .when(given & ~fits, say("character offsets [", start.cast("string"), ", ", end.cast("string"), ") are out of range for the source text."))
            .when(given & ~exact, say("character offsets do not reproduce source_quote.")),
            F.when(found & ~tags_ok, say("concept_tags must be a list of non-empty strings.")),
            F.when(found & ~label_ok, say("speaker_label must be a non-empty string when set.")),
        )
    )


def validate(outputs: DataFrame, nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outputs (run_id, transcript_id, raw_output) against their transcripts (transcript_id, messages).

    Returns runs (run_id, transcript_id, status, error_message, output_claim_count) and the claims of accepted runs with
    their fields, source text and source timestamp.
    """
    judged = outputs.withColumn("_j", strict_json(F.col("raw_output")))
    judged = judged.withColumn("payload", F.expr("try_parse_json(_j.text)"))
    top = judged.select(
        "run_id",
        "transcript_id",
        F.col("_j.error").alias("decode_error"),
        "payload",
        F.when(F.col("_j.ok"), payload_errors(F.col("payload"), F.col("_j.text"))).alias("top_errors"),
    )
    claims = explode_claims(top.filter("payload is not null"))
    messages = nested.select("transcript_id", F.explode("messages").alias("message")).withColumn("_at", F.col("message.index"))
    claims = with_fields(claims).withColumn("_at", F.when(F.col("_k_source_message_index") == "int", F.col("_n_source_message_index")))
    claims = claims.join(messages, ["transcript_id", "_at"], "left")
    label = F.concat(F.lit("claims["), F.col("claim_sequence").cast("string"), F.lit("]"))
    claims = claims.withColumn("errors", claim_errors(label, F.col("message")))
    # errors of a run: bounded by its payload, in order
    found = claims.groupBy("run_id").agg(
        F.count("*").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("errors") > 0, F.struct("claim_sequence", "errors")))), lambda x: x["errors"])).alias("claim_errors")
    )
    runs = top.join(found, "run_id", "left")
    none = F.array().cast("array<string>")
    errors = F.concat(F.coalesce("top_errors", none), F.coalesce("claim_errors", none))
    errors = F.when(F.col("decode_error").isNotNull(), F.array("decode_error")).otherwise(errors)
    message = F.left(F.concat(F.lit("Extraction output failed contract validation: "), F.array_join("_e", "; ")), F.lit(2000))
    runs = runs.withColumn("_e", errors).select(
        "run_id",
        "transcript_id",
        F.when(F.size("_e") > 0, "failed").otherwise("succeeded").alias("status"),
        F.when(F.size("_e") > 0, message).alias("error_message"),
        F.when(F.size("_e") > 0, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("output_claim_count"),
    )
    good = claims.join(runs.filter("status = 'succeeded'").select("run_id"), "run_id", "left_semi")
    b = F.col("_n_source_block_index")
    block = F.get(F.col("message.blocks"), b.cast("int"))
    fields = [F.col(f"_t_{f}").alias(f) for f in ("standalone_claim_text", "speaker_role", "speaker_label", "speech_act_type", "hedge_level", "source_quote")]
    fields += [F.col(f"_n_{f}").alias(f) for f in INTEGERS]
    return runs, good.select(
        "run_id",
        "transcript_id",
        F.col("claim_sequence").cast("long").alias("claim_sequence"),
        *fields,
        F.coalesce(F.try_variant_get(F.col("_v_concept_tags"), "$", "array<string>"), none).alias("concept_tags"),
        F.when(b.isNotNull(), block["text"]).otherwise(F.col("message.text")).alias("source_text"),
        F.col("message.timestamp").alias("source_timestamp"),
    )
