"""Registered queries over the ledger's operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.urls import share_url_gate
from ..operators import contract
from ..operators.citation import fallback_summary, verdict_histogram
from ..operators.extract import unwrap_completion
from ..operators.prompt import nested_messages, prompts
from ..schemas import HEDGE_LEVELS, SPEECH_ACT_TYPES
from ..sources.snapshot import APP_SHELL, CHALLENGE, NO_MESSAGES, parse_snapshots
from . import derived as D
from . import ledger as L
from .registered import query


# DuckDB pieces: the derived ledger, and the text functions
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_IN_LINE = r"[\t \x{1f}\p{Z}]"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _normal(x: str) -> str:
    return f"lower({_strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")})"


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda t: t NOT IN ({_STOP}))"


def _clean(x: str) -> str:
    for pattern, by in ((_BREAK, "chr(10)"), (r"[ \t]+", "' '"), (rf"{_IN_LINE}*\n{_IN_LINE}*", "chr(10)"), (r"\n{{3,}}".replace("{{", "{").replace("}}", "}"), "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return _strip(x)


def _role(x: str) -> str:
    whens = " ".join(rf"WHEN regexp_matches(lower({x}), '(^|[^\pL\pN_]){w}([^\pL\pN_]|$)') THEN '{r}'" for w, r in X.ROLE_ALIASES.items())
    return f"CASE {whens} ELSE 'unknown' END"


def _pick(values: tuple[str, ...], i: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({i}) % {len(values)} + 1]"


_MESSAGES = """
m AS (SELECT 'tr-' || conv_id AS transcript_id, 'conv-' || conv_id AS conversation_id, CAST(turn AS BIGINT) AS message_index, role, text,
             CAST(NULL AS VARCHAR) AS timestamp, '{"source": "conversations"}' AS provenance_json,
             '2026-01-01T00:00:00.000Z' AS created_at, conv_id, turn FROM conversations)"""
_BLOCKS = """
b AS (SELECT transcript_id, message_index, CAST(0 AS BIGINT) AS block_index, 'text' AS block_type, text, CAST(NULL AS VARCHAR) AS language,
             '{}' AS metadata_json, created_at FROM m)"""
_TRANSCRIPTS = """
t AS (SELECT transcript_id, conversation_id, CASE WHEN max(conv_id) % 2 = 0 THEN 'Conversation ' || max(conv_id) END AS title,
             'art-raw-' || max(conv_id) AS source_artifact_id, 'art-tr-' || max(conv_id) AS transcript_artifact_id,
             'json_structured_data' AS parser_method, '2026-01-0' || (max(conv_id) % 9 + 1) || 'T00:00:00Z' AS fetched_at,
             count(*) AS message_count, CAST(0 AS BIGINT) AS warning_count, '2026-01-01T00:00:00.000Z' AS created_at
      FROM m GROUP BY transcript_id, conversation_id)"""
_RAW_CLAIMS = f"""
s AS (SELECT *, regexp_extract(text, '^[^.]*\\.?') AS sentence FROM m),
a AS (SELECT *, lead(sentence) OVER (PARTITION BY conv_id ORDER BY turn) AS after, (conv_id + turn) % 5 AS way FROM s),
c AS (SELECT 'run-' || conv_id AS run_id, 'claim-' || conv_id || '-' || turn AS claim_id, transcript_id, conversation_id,
             CAST(turn AS BIGINT) AS claim_sequence,
             CASE way WHEN 1 THEN sentence || ' ' || coalesce(after, '') WHEN 2 THEN coalesce(after, sentence)
                      WHEN 4 THEN 'it is the and of' ELSE sentence END AS claim, role AS speaker_role, CAST(NULL AS VARCHAR) AS speaker_label,
             {_pick(SPEECH_ACT_TYPES, "conv_id * 7 + turn")} AS speech_act_type, {_pick(HEDGE_LEVELS, "turn")} AS hedge_level,
             message_index AS source_message_index, CASE WHEN turn % 3 = 0 THEN CAST(0 AS BIGINT) END AS source_block_index,
             CASE WHEN turn % 3 = 0 THEN CAST(0 AS BIGINT) END AS source_char_start,
             CASE WHEN turn % 3 = 0 THEN CAST(length(sentence) AS BIGINT) END AS source_char_end,
             CASE WHEN way = 3 THEN sentence || ' zzz' ELSE sentence END AS quote, timestamp AS source_timestamp, '[]' AS concept_tags_json,
             CASE WHEN turn % 4 = 3 THEN 'claim-' || conv_id || '-' || (turn - 1) END AS supersedes_claim_id, created_at, text AS source FROM a)"""
_VERDICTS = f"""
k AS (SELECT *, {_tokens("claim")} AS ct, {_tokens("source")} AS st, {_strip("source")} = '' AS blank,
             contains({_normal("source")}, {_normal("quote")}) AS found FROM c),
v AS (SELECT *, CASE WHEN NOT blank AND found AND len(ct) > 0
                THEN CAST(len(list_filter(ct, lambda x: list_contains(st, x))) AS DOUBLE) / len(ct) END AS cover FROM k),
w AS (SELECT *, CASE WHEN blank THEN 'unknown' WHEN NOT found THEN 'no' WHEN len(ct) = 0 THEN 'unknown' WHEN cover >= 0.75 THEN 'yes'
                     WHEN cover >= 0.40 THEN 'partial' ELSE 'no' END AS support_verdict,
             CAST(NOT blank AND found AS BIGINT) AS quote_found,
             CASE WHEN blank THEN 'Source message text is unavailable, so support cannot be judged.'
                  WHEN NOT found THEN 'source_quote is not a verbatim span of the source message text.'
                  WHEN len(ct) = 0 THEN 'Claim text has no content tokens to compare against the source.'
                  ELSE format('{{:.2f}}', cover) || ' of claim content tokens appear in the source message.' END AS detail,
             CASE WHEN NOT blank AND found THEN quote ELSE {_strip("source")} END AS words FROM v),
f AS (SELECT *, support_verdict IN ('no', 'unknown') AND {_strip("words")} <> '' AS falls FROM w),
r AS (SELECT run_id, claim_id, transcript_id, conversation_id, claim_sequence,
             CASE WHEN falls THEN words ELSE claim END AS standalone_claim_text, speaker_role, speaker_label, speech_act_type, hedge_level,
             source_message_index, source_block_index, source_char_start, source_char_end,
             CASE WHEN falls AND quote_found = 0 THEN words ELSE quote END AS source_quote, source_timestamp, concept_tags_json,
             supersedes_claim_id, created_at, support_verdict, 's1-011-lexical-v1' AS check_method, quote_found,
             CAST(falls AS BIGINT) AS fallback_applied, CASE WHEN falls THEN claim END AS original_claim_text, detail FROM f)"""
_CLAIMS = f"{_RAW_CLAIMS},{_VERDICTS}"
_CHECKS = """
h AS (SELECT 'check-' || claim_id AS check_id, claim_id, run_id, support_verdict, check_method, quote_found, fallback_applied,
             original_claim_text, detail, created_at FROM r)"""
_RUNS = """
n AS (SELECT *, CAST(substring(transcript_id, 4) AS BIGINT) AS num FROM t),
x AS (SELECT 'run-' || num AS run_id, transcript_id, 'rule' AS extractor_name, 's1-009-v2' AS prompt_version, CAST(NULL AS VARCHAR) AS prompt_sha256,
             CAST(NULL AS VARCHAR) AS model, CASE WHEN num % 7 = 6 THEN 'failed' ELSE 'succeeded' END AS status,
             CASE WHEN num % 7 = 6 THEN 'Extractor raised ValueError: no output' END AS error_message, message_count AS input_message_count,
             CASE WHEN num % 7 = 6 THEN 0 ELSE message_count END AS output_claim_count, fetched_at AS started_at, fetched_at AS completed_at,
             created_at FROM n),
o AS (SELECT run_id, 'extractions/' || run_id || '.json' AS file_path, sha256(run_id) AS sha256, CAST(strlen(run_id) AS BIGINT) AS byte_size,
             created_at FROM x WHERE status = 'succeeded')"""


def _sql(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


_C = ", ".join(L.CLAIM_COLUMNS)
_T = ", ".join(L.TRANSCRIPT_COLUMNS)


@query("citation_verdicts", _sql("SELECT claim_id, support_verdict, quote_found, fallback_applied, original_claim_text, detail, standalone_claim_text, source_quote FROM r", _MESSAGES, _CLAIMS))
def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resolved_claims(spark, sf_dir).select(
        "claim_id", "support_verdict", "quote_found", "fallback_applied", "original_claim_text", "detail", "standalone_claim_text", "source_quote"
    )


query("verdict_histogram", _sql("SELECT run_id, support_verdict, count(*) AS n FROM h GROUP BY ALL", _MESSAGES, _CLAIMS, _CHECKS))(
    lambda s, d: verdict_histogram(D.checks(s, d))
)
query("fallback_summary", _sql("SELECT run_id, CAST(sum(fallback_applied) AS BIGINT) AS fallbacks, count(*) AS claims FROM h GROUP BY ALL", _MESSAGES, _CLAIMS, _CHECKS))(
    lambda s, d: fallback_summary(D.checks(s, d))
)
query("claims_all", _sql(f"SELECT {_C} FROM r", _MESSAGES, _CLAIMS))(lambda s, d: L.list_claims(D.tables(s, d)))
query("claims_by_conversation", _sql(f"SELECT {_C} FROM r WHERE conversation_id = 'conv-3'", _MESSAGES, _CLAIMS))(
    lambda s, d: L.list_claims(D.tables(s, d), conversation_id="conv-3")
)
query("claims_by_transcript", _sql(f"SELECT {_C} FROM r WHERE transcript_id = 'tr-4'", _MESSAGES, _CLAIMS))(
    lambda s, d: L.list_claims(D.tables(s, d), transcript_id="tr-4")
)
query("claims_by_speaker", _sql(f"SELECT {_C} FROM r WHERE speaker_role = 'user'", _MESSAGES, _CLAIMS))(
    lambda s, d: L.list_claims(D.tables(s, d), speaker_role="user")
)
query("claims_by_speech_act", _sql(f"SELECT {_C} FROM r WHERE speech_act_type = 'preference'", _MESSAGES, _CLAIMS))(
    lambda s, d: L.list_claims(D.tables(s, d), speech_act_type="preference")
)
query("claims_combined", _sql(f"SELECT {_C} FROM r WHERE speaker_role = 'assistant' AND speech_act_type = 'plan'", _MESSAGES, _CLAIMS))(
    lambda s, d: L.list_claims(D.tables(s, d), speaker_role="assistant", speech_act_type="plan")
)
query("current_claims", _sql(f"SELECT {_C} FROM r WHERE claim_id NOT IN (SELECT supersedes_claim_id FROM r WHERE supersedes_claim_id IS NOT NULL)", _MESSAGES, _CLAIMS))(
    lambda s, d: L.current_claims(D.tables(s, d))
)
query("support_checks_all", _sql("SELECT * FROM h", _MESSAGES, _CLAIMS, _CHECKS))(lambda s, d: L.list_support_checks(D.tables(s, d)))
query("support_checks_by_verdict", _sql("SELECT * FROM h WHERE support_verdict = 'partial'", _MESSAGES, _CLAIMS, _CHECKS))(
    lambda s, d: L.list_support_checks(D.tables(s, d), support_verdict="partial")
)
query("support_checks_by_run", _sql("SELECT * FROM h WHERE run_id = 'run-5'", _MESSAGES, _CLAIMS, _CHECKS))(
    lambda s, d: L.list_support_checks(D.tables(s, d), run_id="run-5")
)
query("transcripts_all", _sql(f"SELECT {_T} FROM t", _MESSAGES, _TRANSCRIPTS))(lambda s, d: L.list_transcripts(D.tables(s, d)))
query("transcripts_by_conversation", _sql(f"SELECT {_T} FROM t WHERE conversation_id = 'conv-2'", _MESSAGES, _TRANSCRIPTS))(
    lambda s, d: L.list_transcripts(D.tables(s, d), conversation_id="conv-2")
)
query("transcript_point", _sql(f"SELECT {_T} FROM t WHERE transcript_id = 'tr-7'", _MESSAGES, _TRANSCRIPTS))(
    lambda s, d: D.transcripts(s, d).filter("transcript_id = 'tr-7'").select(*L.TRANSCRIPT_COLUMNS)
)
query(
    "messages_of_transcript",
    _sql("SELECT transcript_id, conversation_id, message_index, role, text, timestamp, provenance_json FROM m WHERE transcript_id = 'tr-1'", _MESSAGES),
)(lambda s, d: L.list_transcript_messages(D.tables(s, d), "tr-1"))
query(
    "blocks_of_transcript",
    _sql("SELECT transcript_id, message_index, block_index, block_type, text, language, metadata_json FROM b WHERE transcript_id = 'tr-1'", _MESSAGES, _BLOCKS),
)(lambda s, d: L.list_message_blocks(D.tables(s, d), "tr-1"))
query(
    "runs_with_outputs",
    _sql("SELECT x.*, o.file_path AS raw_output_path, o.sha256 AS raw_output_sha256, o.byte_size AS raw_output_byte_size FROM x LEFT JOIN o USING (run_id)", _MESSAGES, _TRANSCRIPTS, _RUNS),
)(lambda s, d: L.list_extraction_runs(D.tables(s, d)))


@query(
    "claim_source_trace",
    _sql(
        "SELECT r.claim_id, m.message_index, m.role, m.text AS message_text, b.block_index, b.text AS block_text FROM r"
        " LEFT JOIN m ON m.transcript_id = r.transcript_id AND m.message_index = r.source_message_index"
        " LEFT JOIN b ON b.transcript_id = r.transcript_id AND b.message_index = r.source_message_index AND b.block_index = r.source_block_index",
        _MESSAGES, _BLOCKS, _CLAIMS,
    ),
)
def claim_source_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.claim_sources(D.tables(spark, sf_dir))
    return found.select(
        "claim.claim_id", "source_message.message_index", "source_message.role", F.col("source_message.text").alias("message_text"),
        "source_block.block_index", F.col("source_block.text").alias("block_text"),
    )


@query(
    "nested_transcript",
    _sql(
        "SELECT m.transcript_id, count(*) AS messages, CAST(sum(CASE WHEN b.text IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS blocks,"
        " string_agg(m.role, ',' ORDER BY m.message_index) AS roles, sha256(string_agg(b.text, chr(10) ORDER BY m.message_index)) AS text_sha256"
        " FROM m LEFT JOIN b USING (transcript_id, message_index) GROUP BY m.transcript_id",
        _MESSAGES, _BLOCKS,
    ),
)
def nested_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nested_messages(D.messages(spark, sf_dir), D.blocks(spark, sf_dir))
    texts = F.flatten(F.transform("messages", lambda m: F.transform(m["blocks"], lambda b: b["text"])))
    return n.select(
        "transcript_id", F.size("messages").cast("long").alias("messages"), F.size(texts).cast("long").alias("blocks"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.sha2(F.array_join(texts, "\n"), 256).alias("text_sha256"),
    )


_PROMPT = _sql(
    "SELECT t.transcript_id, 'conversation_id: ' || t.conversation_id || coalesce(chr(10) || 'title: ' || t.title, '') || chr(10) || chr(10) || g.said AS body,"
    " FROM t JOIN (SELECT transcript_id, string_agg('[' || message_index || '] ' || role || ' (no timestamp):' || chr(10) || text || chr(10), chr(10)"
    " ORDER BY message_index) AS said FROM m GROUP BY transcript_id) g USING (transcript_id)",
    _MESSAGES, _TRANSCRIPTS,
)


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(D.transcripts(spark, sf_dir), D.messages(spark, sf_dir), D.blocks(spark, sf_dir))


query("prompt_text", _PROMPT)(
    lambda s, d: _prompts(s, d).select("transcript_id", F.expr("substring(prompt, locate('\nTranscript:\n', prompt) + 13)").alias("body"))
)
query("prompt_sha256", f"SELECT transcript_id, sha256(body) AS body_sha256 FROM ({_PROMPT})")(
    lambda s, d: _prompts(s, d).select("transcript_id", F.expr("sha2(substring(prompt, locate('\nTranscript:\n', prompt) + 13), 256)").alias("body_sha256"))
)

# text functions
query("content_tokens", f"SELECT conv_id, turn, array_to_string(list_sort({_tokens('text')}), ' ') AS tokens FROM conversations")(
    lambda s, d: D.read(s, d, "conversations").select("conv_id", "turn", F.array_join(F.sort_array(X.content_tokens(F.col("text"))), " ").alias("tokens"))
)
query("normalize_text", f"SELECT doc_id, sha256({_normal('text')}) AS normal FROM documents")(
    lambda s, d: D.read(s, d, "documents").select("doc_id", F.sha2(X.normalize_evidence(F.col("text")), 256).alias("normal"))
)
query("clean_text", f"SELECT doc_id, sha256({_clean('text')}) AS clean FROM documents")(
    lambda s, d: D.read(s, d, "documents").select("doc_id", F.sha2(X.clean_text(F.col("text")), 256).alias("clean"))
)
query("role_normalize", f"SELECT conv_id, turn, {_role('text')} AS in_text, {_role('role')} AS in_role FROM conversations")(
    lambda s, d: D.read(s, d, "conversations").select("conv_id", "turn", X.normalize_role(F.col("text")).alias("in_text"), X.normalize_role(F.col("role")).alias("in_role"))
)


@query(
    "message_text_render",
    f"""SELECT conv_id, turn, {_strip("array_to_string(list_filter([text, '```sql' || chr(10) || text || chr(10) || '```', ''], lambda p: p <> ''), chr(10) || chr(10))")} AS rendered
        FROM conversations""",
)
def message_text_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind, text, language: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(language).cast("string").alias("language"))
    blocks = F.array(part("text", F.col("text"), None), part("code", F.col("text"), "sql"), part("table", F.lit(""), None))
    return D.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.message_text(blocks).alias("rendered"))


query(
    "drop_role_label",
    f"""SELECT conv_id, turn, CASE WHEN {_role("role")} <> 'unknown' THEN {_strip("text")} ELSE role || ':' || chr(10) || text END AS rest FROM conversations""",
)(lambda s, d: D.read(s, d, "conversations").select("conv_id", "turn", X.drop_role_label(F.concat("role", F.lit(":\n"), "text")).alias("rest")))


@query(
    "share_url_gate",
    r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
        lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u),
        e AS (SELECT *, CASE WHEN scheme <> 'https' THEN 'scheme' WHEN host NOT IN ('blog.tionsh.example.net', 'thther.example.org') THEN 'host'
              WHEN len(parts) <> 2 OR parts[1] <> 'en' THEN 'path' END AS error FROM p)
        SELECT page_id, error, CASE WHEN error IS NULL THEN parts[2] END AS conversation_id FROM e""",
)
def share_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = share_url_gate(F.col("url"), ("blog.tionsh.example.net", "thther.example.org"), "en")
    return D.read(spark, sf_dir, "pages").select("page_id", g.alias("g")).select("page_id", "g.error", "g.conversation_id")


query(
    "source_sniff",
    rf"""SELECT page_id, CASE WHEN regexp_matches(html, '^{_WS}*[\{{\[]') THEN 'json' ELSE 'html' END AS format,
         contains(lower(html), 'just a moment') AND contains(lower(html), 'challenges.cloudflare.com') AS challenge,
         contains(lower(html), '<div id="root"></div>') AND contains(lower(html), 'claude-ai') AS shell FROM pages""",
)(
    lambda s, d: D.read(s, d, "pages").select(
        "page_id", X.sniff_format(F.col("html")).alias("format"), X.is_challenge(F.col("html")).alias("challenge"), X.is_app_shell(F.col("html")).alias("shell")
    )
)


query(
    "snapshot_diagnosis",
    """SELECT page_id, CASE WHEN contains(lower(html), 'cf-mitigated') AND contains(lower(html), 'challenge') THEN 'challenge'
       WHEN regexp_matches(html, '<div id="root">\\s*</div>') AND contains(lower(html), 'claude-ai') AND NOT contains(lower(html), 'chat_snapshots')
       THEN 'app_shell' END AS reason FROM (SELECT page_id, html FROM pages UNION ALL
       SELECT -page_id - 1, '<div id="root"> </div> claude-ai ' || url FROM pages)""",
)(
    lambda s, d: D.read(s, d, "pages").select("page_id", "html").unionByName(
        D.read(s, d, "pages").select((-F.col("page_id") - 1).alias("page_id"), F.concat(F.lit('<div id="root"> </div> claude-ai '), "url").alias("html"))
    ).select("page_id", X.empty_snapshot_reason(F.col("html"), F.col("html").rlike(r'<div id="root">\s*</div>')).alias("reason"))
)


@query(
    "artifact_fingerprint",
    "SELECT page_id AS id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS byte_size, 'text/html' AS media_type FROM pages"
    " UNION ALL SELECT doc_id, sha256(text), CAST(strlen(text) AS BIGINT), 'application/octet-stream' FROM documents",
)
def artifact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(table: str, key: str, column: str, name: str) -> DataFrame:
        parts = X.artifact_columns(F.col(column), F.lit(name))
        return D.read(spark, sf_dir, table).select(F.col(key).alias("id"), *[c.alias(n) for n, c in parts.items()])

    return of("pages", "page_id", "html", "page.html").unionByName(of("documents", "doc_id", "text", "doc.bin"))


_TITLE = _clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_entity}', '{_char}')"


@query("page_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common case natively: the first title element, its five named entities decoded."""
    t = X.clean_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return D.read(spark, sf_dir, "pages").select("page_id", t.alias("title"))


_NOTHING = f"""SELECT page_id, 'rendered_html' AS method, CAST(0 AS BIGINT) AS messages, CASE page_id % 4 WHEN 1 THEN '{APP_SHELL}' WHEN 2 THEN '{CHALLENGE}'
               ELSE '{NO_MESSAGES}' END AS error FROM pages"""


@query("parse_failures", _NOTHING)
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without messages: as they are, as an empty shell, as a challenge, and as JSON whose one list has no speakers."""
    way = F.col("page_id") % 4
    shell = F.concat(F.lit('<div id="root"> </div><script src="/claude-ai.js"></script><p>'), "url", F.lit("</p>"))
    challenge = F.concat(F.lit("<p>cf-mitigated: challenge</p>"), "html")
    silent = F.to_json(F.struct(F.array(F.struct(F.col("url").alias("text"))).alias("messages")))
    text = F.when(way == 1, shell).when(way == 2, challenge).when(way == 3, silent).otherwise(F.col("html"))
    pages = D.read(spark, sf_dir, "pages").select("page_id", text.alias("text"))
    return parse_snapshots(pages).select("page_id", "parsed.method", F.size("parsed.messages").cast("long").alias("messages"), "parsed.error")


_TRIP = f"""SELECT 'conv-' || conv_id AS conversation_id, CAST(turn AS BIGINT) AS message_index, {_role("role")} AS role, {_clean("text")} AS text FROM conversations"""


def _flat(parsed: DataFrame) -> DataFrame:
    m = parsed.select("conversation_id", F.explode("parsed.messages").alias("m"))
    return m.select("conversation_id", F.col("m.index").alias("message_index"), "m.role", "m.text")


def _turns(spark: SparkSession, sf_dir: str, *fields) -> DataFrame:
    c = D.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("conversation_id"), "turns")


@query("snapshot_json_roundtrip", _TRIP)
def snapshot_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as snapshot JSON, parsed again."""
    body = F.transform("turns", lambda t: F.struct(t["role"].alias("sender"), t["text"].alias("text")))
    snap = _turns(spark, sf_dir).select("conversation_id", F.to_json(F.struct(F.col("conversation_id").alias("name"), body.alias("chat_messages"))).alias("text"))
    return _flat(parse_snapshots(snap))


@query("snapshot_html_roundtrip", _TRIP)
def snapshot_html_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rendered pages, parsed again."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = lambda t: F.concat(F.lit('<article data-role="'), t["role"], F.lit('"><h2>'), t["role"], F.lit("</h2><p>"), safe(t["text"]), F.lit("</p></article>"))
    page = F.concat(F.lit("<html><body>"), F.array_join(F.transform("turns", item), "\n"), F.lit("</body></html>"))
    return _flat(parse_snapshots(_turns(spark, sf_dir).select("conversation_id", page.alias("text"))))


# the contract: each conversation is an output of one claim per turn, each with faults by its number x
_X = "(conv_id * 7 + turn * 5)"


def _claim_json() -> Column:
    """The claim of a turn as JSON text; ``x % n = r`` puts one fault in, and several may meet."""
    x = F.expr(_X)
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"\A\[|\]\z", "")

    def field(name: str, usual: Column, *faults: tuple[int, int, str | None]) -> Column:
        """``"name": value``; a fault gives the value's JSON, or None to leave the field out."""
        out = F.concat(F.lit(f'"{name}": '), usual)
        for n, r, value in faults:
            out = F.when(x % n == r, F.lit(None).cast("string") if value is None else F.lit(f'"{name}": {value}')).otherwise(out)
        return out

    none = F.lit("null")
    quote = F.when(x % 15 == 14, quoted(F.substring("text", 1, 5))).otherwise(quoted(F.substring("text", 3, 4)))
    index = F.when(x % 8 == 6, F.col("turn") + 100000).otherwise(F.col("turn")).cast("string")
    fields = [
        field("standalone_claim_text", F.lit('"A claim."'), (5, 0, '" "')),
        field("source_quote", quote, (13, 3, "3"), (11, 2, None)),
        field("speaker_role", quoted(F.col("role")), (6, 1, '"visitor"'), (6, 2, '"unknown"')),
        field("speech_act_type", F.lit('"fact"'), (9, 4, "true"), (9, 5, "null")),
        field("hedge_level", F.lit('"none"'), (10, 7, "7"), (11, 2, None)),
        field("source_message_index", index, (8, 5, '"1"'), (16, 3, "true")),
        field("source_block_index", none, (4, 1, "0"), (12, 2, "5"), (12, 7, '"0"')),
        field("source_char_start", none, (15, 3, "1"), (15, 6, "1"), (15, 9, "3"), (15, 12, "1"), (15, 14, "0")),
        field("source_char_end", none, (15, 6, '"4"'), (15, 9, "3"), (15, 12, "4"), (15, 14, "5"), (15, 1, "9")),
        field("concept_tags", F.lit('["a", "b"]'), (14, 2, '["a", " "]'), (14, 5, '"a"'), (14, 9, "null")),
        field("speaker_label", F.lit('"S"'), (17, 4, '""'), (17, 8, "5"), (17, 12, "null")),
        F.when(x % 7 == 1, '"note": 1, "also": 2'),
    ]
    return F.when(x % 23 == 0, '"no object"').otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs, some with faults at the top; one of ten has a single faultless claim."""
    m = D.messages(spark, sf_dir).withColumn("claim", _claim_json())
    runs = m.groupBy("transcript_id", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "claim"))).alias("c"))
    claims = F.concat(F.lit("["), F.array_join(F.transform("c", lambda c: c["claim"]), ", "), F.lit("]"))
    way = F.col("conv_id") % 13
    raw = (
        F.when(way == 1, F.concat(F.lit('{"b": 1, "claims": '), claims, F.lit(', "a": 2}')))
        .when(way == 2, '{"claims": {}, "c": 1}')
        .when(way == 3, "nope")
        .when(way == 4, claims)
        .when(way == 5, '{"claims": []}')
        .otherwise(F.concat(F.lit('{"claims": '), claims, F.lit("}")))
    )
    return runs.select(F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("run_id"), "transcript_id", raw.alias("raw_output"))


def _fault(n: int, *rests: int) -> str:
    return f"x % {n} IN ({', '.join(map(str, rests))})"


_CONTRACT = f"""WITH x AS (SELECT *, {_X} AS x FROM conversations),
p AS (SELECT *, x % 23 <> 0 AS object, NOT {_fault(11, 2)} AS complete, NOT ({_fault(8, 5)} OR {_fault(16, 3)}) AS numbered,
             CASE WHEN {_fault(12, 7)} THEN 'text' WHEN {_fault(12, 2)} THEN 'far' WHEN {_fault(4, 1)} THEN 'fine' ELSE 'none' END AS block,
             CASE WHEN {_fault(6, 2)} THEN 'unknown' WHEN {_fault(6, 1)} THEN 'visitor' ELSE role END AS told,
             CASE WHEN {_fault(15, 14)} THEN substring(text, 1, 5) ELSE substring(text, 3, 4) END AS quote FROM x),
f AS (SELECT *, object AND complete AS all_there, object AND complete AND numbered AS placed,
             object AND complete AND numbered AND NOT {_fault(8, 6)} AS found FROM p),
e AS (SELECT conv_id, turn, list_filter([
  CASE WHEN NOT object THEN 'claim must be a JSON object.' END,
  CASE WHEN object AND {_fault(7, 1)} THEN 'unexpected fields [''also'', ''note'']' END,
  CASE WHEN object AND NOT complete THEN 'missing required fields [''hedge_level'', ''source_quote'']' END,
  CASE WHEN all_there AND {_fault(5, 0)} THEN 'standalone_claim_text must be a non-empty string.' END,
  CASE WHEN all_there AND ({_fault(13, 3)} OR {_strip("quote")} = '') THEN 'source_quote must be a non-empty string.' END,
  CASE WHEN all_there AND told = 'visitor' THEN 'invalid speaker_role ''visitor''.' END,
  CASE WHEN all_there AND {_fault(9, 4)} THEN 'invalid speech_act_type True.' WHEN all_there AND {_fault(9, 5)} THEN 'invalid speech_act_type None.' END,
  CASE WHEN all_there AND {_fault(10, 7)} THEN 'invalid hedge_level 7.' END,
  CASE WHEN all_there AND NOT numbered THEN 'source_message_index must be an integer.' END,
  CASE WHEN placed AND NOT found THEN 'source_message_index ' || (turn + 100000) || ' is not in the transcript.' END,
  CASE WHEN found AND told = 'unknown' THEN 'speaker_role ''unknown'' does not match source message role ''' || role || '''.' END,
  CASE WHEN found AND block = 'text' THEN 'source_block_index must be an integer.' END,
  CASE WHEN found AND block = 'far' THEN 'source_block_index 5 is not in message ' || turn || '.' END,
  CASE WHEN found AND {_fault(15, 1, 3)} THEN 'source_char_start and source_char_end must be provided together.' END,
  CASE WHEN found AND {_fault(15, 6)} THEN 'character offsets must be integers.'
       WHEN found AND {_fault(15, 9)} THEN 'character offsets [3, 3) are out of range for the source text.'
       WHEN found AND {_fault(15, 12)} AND ({_fault(13, 3)} OR quote <> substring(text, 2, 3)) THEN 'character offsets do not reproduce source_quote.'
       WHEN found AND {_fault(15, 14)} AND {_fault(13, 3)} THEN 'character offsets do not reproduce source_quote.' END,
  CASE WHEN found AND {_fault(14, 2, 5)} THEN 'concept_tags must be a list of non-empty strings.' END,
  CASE WHEN found AND {_fault(17, 4, 8)} THEN 'speaker_label must be a non-empty string when set.' END], lambda m: m IS NOT NULL) AS errors FROM f),
n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, errors FROM e),
g AS (SELECT conv_id, count(*) AS claims, flatten(list(list_transform(errors, lambda m: 'claims[' || place || ']: ' || m) ORDER BY turn)) AS errors FROM n GROUP BY conv_id),
r AS (SELECT conv_id, claims, CASE conv_id % 13
        WHEN 1 THEN list_concat(['Unexpected top-level keys: [''a'', ''b'']'], errors)
        WHEN 2 THEN ['Unexpected top-level keys: [''c'']', 'Output must contain a "claims" list.']
        WHEN 3 THEN ['Output is not valid JSON: Expecting value: line 1 column 1 (char 0)']
        WHEN 4 THEN ['Output JSON must be an object.'] WHEN 5 THEN [] ELSE errors END AS errors FROM g)
SELECT 'run-' || conv_id AS run_id, 'tr-' || conv_id AS transcript_id, CASE WHEN len(errors) > 0 THEN 'failed' ELSE 'succeeded' END AS status,
       CASE WHEN len(errors) > 0 THEN left('Extraction output failed contract validation: ' || array_to_string(errors, '; '), 2000) END AS error_message,
       CASE WHEN len(errors) > 0 OR conv_id % 13 = 5 THEN CAST(0 AS BIGINT) ELSE claims END AS output_claim_count FROM r"""


@query("contract_errors", _CONTRACT)
def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nested_messages(D.messages(spark, sf_dir), D.blocks(spark, sf_dir))
    return contract.validate(_payloads(spark, sf_dir), nested)[0]


query("run_outcomes", f"SELECT status, count(*) AS runs, CAST(sum(output_claim_count) AS BIGINT) AS claims FROM ({_CONTRACT}) GROUP BY status")(
    lambda s, d: contract_errors(s, d).groupBy("status").agg(F.count("*").alias("runs"), F.sum("output_claim_count").alias("claims"))
)


@query(
    "constraint_violations",
    """WITH x AS (SELECT conv_id, turn FROM conversations UNION ALL SELECT conv_id, turn FROM conversations WHERE turn = 0)
       SELECT 'transcript_messages' AS table_name, 'check:role' AS rule, count(*) AS n FROM x WHERE turn % 11 = 5 HAVING count(*) > 0
       UNION ALL SELECT 'transcript_messages', 'references:transcripts(transcript_id)', count(*) FROM x WHERE conv_id % 10 = 3 HAVING count(*) > 0
       UNION ALL SELECT 'transcript_messages', 'unique:transcript_id,message_index', count(*)
                 FROM (SELECT conv_id, turn FROM x GROUP BY conv_id, turn HAVING count(*) > 1) HAVING count(*) > 0""",
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with broken roles, repeated first turns and missing transcripts, against the rules."""
    m = D.messages(spark, sf_dir)
    bad = m.withColumn("role", F.when(F.col("turn") % 11 == 5, "nobody").otherwise(F.col("role"))).drop("turn", "conv_id")
    bad = bad.unionByName(bad.filter("message_index = 0"))
    there = D.transcripts(spark, sf_dir).filter("cast(substring(transcript_id, 4) as bigint) % 10 <> 3")
    return L.violations("transcript_messages", bad, {"transcripts": there})


@query(
    "code_fence_strip",
    f"SELECT conv_id, turn, {_strip('text')} AS content FROM conversations",
)
def code_fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```\n"))
    return D.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip_code_fence(fenced).alias("content"))


@query(
    "completion_unwrap",
    f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN {_strip('text')} END AS content,
        CASE turn % 4 WHEN 1 THEN 'LLM API returned an error: busy' WHEN 2 THEN 'LLM API response for model ''m'' contained no choices.'
        WHEN 3 THEN 'Model ''m'' output was truncated at the max_tokens limit; the extraction JSON is incomplete.' END AS error FROM conversations""",
)
def completion_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("turn") % 4
    choice = F.struct(F.when(way == 3, "length").otherwise(F.lit("stop")).alias("finish_reason"), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))
    whole = F.struct(F.when(way == 1, F.struct(F.lit("busy").alias("message"))).alias("error"), F.when(way != 2, F.array(choice)).alias("choices"))
    r = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", unwrap_completion(F.to_json(whole), "m").alias("r"))
    return r.select("conv_id", "turn", "r.content", "r.error")


query("event_props_json", "SELECT event_id, json_valid(props) AS valid, json_type(props) = 'OBJECT' AS is_object FROM events")(
    lambda s, d: D.read(s, d, "events").select(
        "event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT").alias("is_object")
    )
)
