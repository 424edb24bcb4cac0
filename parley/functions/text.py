"""Text functions as Spark columns; all stay in the JVM.

White space is Unicode's plus the separators U+001C to U+001F, wherever a text is stripped or squeezed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Words that carry no content.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it its of on or that the their then there these this to was were will with".split()
)
#: Role words, in the order in which they are sought.
CHALLENGE_MARKS = ("just a moment", "challenges.cloudflare.com")
ROLE_ALIASES = {"human": "user", "user": "user", "you": "user", "assistant": "assistant", "claude": "assistant", "system": "system"}


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")


def is_blank(x: Column) -> Column:
    return ~x.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")


def normalize_evidence(x: Column) -> Column:
    """One space for any run of white space, none at the ends, lower case."""
    return F.lower(strip(F.regexp_replace(x, f"{WS}+", " ")))


def content_tokens(x: Column) -> Column:
    """Distinct ASCII words and numbers of the lower-cased text, without stop words."""
    found = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def clean_text(x: Column) -> Column:
    """Lines stripped and squeezed, at most one empty line in a row, none at the ends."""
    inner = r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]"
    steps = ((LINE_BREAK, "\n"), (r"[ \t]+", " "), (rf"{inner}*\n{inner}*", "\n"), (r"\n{3,}", "\n\n"))
    return strip(reduce(lambda a, s: F.regexp_replace(a, *s), steps, x))


def normalize_role(x: Column) -> Column:
    """The role of the first role word in the fixed order that the text holds as a word, or unknown."""
    low = F.lower(x)
    out = F.lit("unknown")
    for word, role in reversed(ROLE_ALIASES.items()):
        out = F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])"), role).otherwise(out)
    return out


def drop_role_label(x: Column) -> Column:
    """Without the first line, if that holds a role word."""
    first = F.split_part(x, F.lit("\n"), F.lit(1))
    rest = F.when(F.instr(x, "\n") > 0, F.substring(x, F.length(first) + 2, F.length(x))).otherwise("")
    return F.when(normalize_role(first) != "unknown", strip(rest)).otherwise(x)


def message_text(blocks: Column) -> Column:
    """Texts of blocks, code fenced, empty ones left out, an empty line between."""
    fenced = F.transform(
        blocks,
        lambda b: F.when(
            b["type"] == "code", F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), b["text"], F.lit("\n```"))
        ).otherwise(b["text"]),
    )
    return strip(F.array_join(F.filter(fenced, lambda t: t != ""), "\n\n"))


def sniff_format(x: Column) -> Column:
    return F.when(x.rlike(rf"\A{WS}*[\{{\[]"), "json").otherwise("html")


def is_challenge(x: Column) -> Column:
    low = F.lower(x)
    return low.contains(CHALLENGE_MARKS[0]) & low.contains(CHALLENGE_MARKS[1])


def is_app_shell(x: Column) -> Column:
    low = F.lower(x)
    return low.contains('<div id="root"></div>') & low.contains("claude-ai")


def empty_snapshot_reason(x: Column, empty_root: Column) -> Column:
    """Code of why a page holds no transcript: challenge, app_shell or null."""
    low = F.lower(x)
    return F.when(low.contains("cf-mitigated") & low.contains("challenge"), "challenge").when(
        empty_root & low.contains("claude-ai") & ~low.contains("chat_snapshots"), "app_shell"
    )


def strip_code_fence(x: Column) -> Column:
    """Without a fence around the whole text: its first line, and its last if that is only the closing fence."""
    t = strip(x)
    body = F.when(F.regexp_instr(t, F.lit(LINE_BREAK)) > 0, F.regexp_replace(t, rf"\A[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*(?:{LINE_BREAK})", "")).otherwise("")
    body = F.regexp_replace(body, LINE_BREAK, "\n")
    body = F.regexp_replace(body, rf"(\A|\n){WS}*```{WS}*\z", "")
    return F.when(t.startswith("```"), strip(body)).otherwise(t)


def artifact_columns(content: Column, path: Column) -> dict[str, Column]:
    """Fingerprint of an artifact: sha256, byte_size, media_type."""
    from ..schemas import DEFAULT_MEDIA_TYPE, MEDIA_TYPES

    media = F.lit(DEFAULT_MEDIA_TYPE)
    for suffix, kind in MEDIA_TYPES.items():
        media = F.when(F.lower(path).endswith(suffix), kind).otherwise(media)
    data = content.cast("binary")
    return {"sha256": F.sha2(data, 256), "byte_size": F.octet_length(data).cast("long"), "media_type": media}


def stamp(ts: Column) -> Column:
    """ISO-8601 in UTC, whole seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamp_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def file_stamp(text: Column) -> Column:
    return F.translate(text, "-:.", "")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Ids from natural keys, so that a retried task or replayed batch writes the same."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 32))


def json_text_array(x: Column) -> Column:
    """JSON of an array of strings with a space after each comma."""
    quoted = F.transform(x, lambda t: F.regexp_replace(F.to_json(F.array(t)), r"\A\[|\]\z", ""))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
