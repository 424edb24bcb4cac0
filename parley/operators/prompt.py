"""Extraction prompts, one per transcript, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import HEDGE_LEVELS, SPEAKER_ROLES, SPEECH_ACT_TYPES

INSTRUCTIONS = f"""\
Read the one conversation below and list the claims in it that are worth keeping: single statements by one speaker that
can stand alone. Use nothing but the conversation, add nothing to what was said and keep its degree of confidence.

Answer with one JSON object of the single key "claims": a list of objects with the keys standalone_claim_text,
speaker_role ({', '.join(SPEAKER_ROLES)}), speech_act_type ({', '.join(SPEECH_ACT_TYPES)}),
hedge_level ({', '.join(HEDGE_LEVELS)}), source_message_index and source_quote (copied word for word);
source_block_index, source_char_start, source_char_end, speaker_label and concept_tags may be added.
Offsets count characters of the block if one is named, else of the message, and must give the quote exactly.
If nothing is worth keeping, the list is empty.
"""


def nested_messages(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(transcript_id, messages): messages in order, each with its blocks in order. A group is one transcript."""
    own = blocks.groupBy("transcript_id", "message_index").agg(
        F.array_sort(F.collect_list(F.struct("block_index", F.col("block_type").alias("type"), "text", "language"))).alias("blocks")
    )
    joined = messages.join(own, ["transcript_id", "message_index"], "left")
    none = F.array().cast("array<struct<block_index:bigint,type:string,text:string,language:string>>")
    item = F.struct(F.col("message_index").alias("index"), "role", "text", "timestamp", F.coalesce("blocks", none).alias("blocks"))
    return joined.groupBy("transcript_id").agg(F.array_sort(F.collect_list(item), lambda a, b: F.sign(a["index"] - b["index"]).cast("int")).alias("messages"))


def render_prompt(conversation_id: Column, title: Column, messages: Column, instructions: str = INSTRUCTIONS) -> Column:
    """Instructions, the conversation's id and title, and each message under its index, role and time."""
    said = F.transform(
        messages,
        lambda m: F.concat(
            F.lit("["),
            m["index"].cast("string"),
            F.lit("] "),
            m["role"],
            F.lit(" ("),
            F.when(F.coalesce(m["timestamp"], F.lit("")) == "", "no timestamp").otherwise(m["timestamp"]),
            F.lit("):\n"),
            m["text"],
            F.lit("\n"),
        ),
    )
    head = F.concat(F.lit(instructions + "\nTranscript:\nconversation_id: "), F.coalesce(conversation_id, F.lit("unknown")))
    titled = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("\ntitle: "), title)).otherwise("")
    return F.concat(head, titled, F.lit("\n"), F.when(F.size(said) > 0, F.concat(F.lit("\n"), F.array_join(said, "\n"))).otherwise(""))


def prompts(transcripts: DataFrame, messages: DataFrame, blocks: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(transcript_id, conversation_id, messages, prompt, prompt_sha256)."""
    none = F.array().cast("array<struct<index:bigint,role:string,text:string,timestamp:string,blocks:array<struct<block_index:bigint,type:string,text:string,language:string>>>>")
    joined = transcripts.join(nested_messages(messages, blocks), "transcript_id", "left").withColumn("messages", F.coalesce("messages", none))
    text = render_prompt(F.col("conversation_id"), F.col("title"), F.col("messages"), instructions)
    return joined.select("transcript_id", "conversation_id", "messages", text.alias("prompt")).withColumn("prompt_sha256", F.sha2(F.col("prompt"), 256))
