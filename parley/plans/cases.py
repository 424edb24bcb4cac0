"""Registered queries over snapshots with parts of every kind, the rows that ``ingest`` and ``run_extraction`` make of them,
and lines for people; with their DuckDB SQL.

The snapshots are written from ``conversations`` by a fixed rule: six forms of a message in JSON, four on a rendered page.
Their words are letters and spaces only, so that SQL can write the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import text as X
from ..functions.urls import snapshot_api_url
from ..operators.extract import run_extraction, table_extractor
from ..operators.ingest import ingest, transcript_json
from ..operators.prompt import INSTRUCTIONS
from ..schemas import TABLES
from ..sources.snapshot import TOOL_TEXT, WARNINGS, parse_snapshots
from ..streaming.captures import capture_frame
from . import catalog as C
from . import derived as D
from . import ledger as L
from .registered import query

NOW = "2026-03-04T05:06:07Z"

_SAID = r"trim(regexp_replace('Note ' || regexp_replace(regexp_extract(text, '^[^.\n]*'), '[^\pL ]', '', 'g'), ' +', ' ', 'g'))"
_SAYS = f"""
y AS (SELECT conv_id, turn, role, text, {_SAID} AS said, turn % 6 AS form, 'conv-' || conv_id AS conversation_id,
             '2026-01-01T0' || (turn % 10) || ':00:00Z' AS made FROM conversations)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.regexp_replace(F.regexp_extract("text", r"^[^.\n]*", 0), r"[^\p{L} ]", "")
    said = F.trim(F.regexp_replace(F.concat(F.lit("Note "), head), " +", " "))
    made = F.concat(F.lit("2026-01-01T0"), (F.col("turn") % 10).cast("string"), F.lit(":00:00Z"))
    rows = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", said.alias("said"), (F.col("turn") % 6).alias("form"), made.alias("made"))
    return rows.withColumn("conversation_id", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))


# a message of each form as JSON text; ``{said}`` and the like stand for its values
_FORMS = (
    '{"role": "{role}", "content": "{said}", "created_at": "{made}"}',
    '{"sender": "{role}", "content": [{"type": "text", "text": "{said}"}, {"type": "code", "language": "sql", "text": "SELECT {turn}"}]}',
    '{"Author": "x", "author": {"name": "{role}"}, "content": [{"type": "table", "text": "| {turn} |"}, {"kind": "tool_use", "input": {"value": "q"}}], "timestamp": "{made}"}',
    '{"speaker": "{role}", "parts": [{"children": ["{said}", {"items": [{"type": "image", "name": "i{turn}.png"}]}]}, {turn}, null]}',
    '{"type": "{role}", "text": "{said}", "attachments": [{"file_name": "a{turn}.pdf"}, "skipped"], "files": [{}], "updated_at": "{made}"}',
    '{"role": "{role}", "content": ""}',
)
_VALUES = ("role", "said", "made", "turn")


def _fill_spark(form: str) -> Column:
    out = F.lit(form)
    for v in _VALUES:
        out = F.replace(out, F.lit("{" + v + "}"), F.col(v).cast("string"))
    return out


def _fill_sql(form: str) -> str:
    out = f"'{form}'"
    for v in _VALUES:
        out = f"replace({out}, '{{{v}}}', CAST({v} AS VARCHAR))"
    return out


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, text): a title, the messages, and a shorter list that must not win."""
    item = F.lit(_FORMS[-1])
    for i, form in enumerate(_FORMS):
        item = F.when(F.col("form") == i, _fill_spark(form)).otherwise(item)
    rows = _said(spark, sf_dir).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
    listed = F.array_join(F.transform("items", lambda x: x["item"]), ", ")
    head = F.concat(F.lit('{"name": "Title of '), "conversation_id", F.lit('", "chat_messages": ['))
    return rows.select("conversation_id", F.concat(head, listed, F.lit('], "noise": [{"role": "user", "text": "short"}]}')).alias("text"))


_ITEM = "CASE form " + " ".join(f"WHEN {i} THEN {_fill_sql(f)}" for i, f in enumerate(_FORMS)) + " END"
_FILES = f"""
z AS (SELECT conversation_id, '{{"name": "Title of ' || conversation_id || '", "chat_messages": [' || string_agg({_ITEM}, ', ' ORDER BY turn)
             || '], "noise": [{{"role": "user", "text": "short"}}]}}' AS text FROM y GROUP BY conversation_id)"""
_TOOL = '{"structured_type": "tool_use"}'
_PARTS = f"""
a AS (SELECT *, unnest(CASE form
        WHEN 0 THEN [['text', said, '', '{{}}']]
        WHEN 1 THEN [['text', said, '', '{{}}'], ['code', 'SELECT ' || turn, 'sql', '{{}}']]
        WHEN 2 THEN [['table', '| ' || turn || ' |', '', '{{}}'], ['tool', '{TOOL_TEXT}', '', '{_TOOL}']]
        WHEN 3 THEN [['text', said, '', '{{}}'], ['attachment', '[Attachment not captured: i' || turn || '.png]', '', '{{}}'], ['text', '' || turn, '', '{{}}']]
        WHEN 4 THEN [['text', said, '', '{{}}'], ['attachment', '[Attachment not captured: a' || turn || '.pdf]', '', '{{}}'],
                     ['attachment', '[Attachment not captured: file]', '', '{{}}']] END) AS part,
      unnest(range(CASE form WHEN 0 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 2 END)) AS block_index FROM y WHERE form <> 5),
k AS (SELECT conversation_id, CAST(turn AS BIGINT) AS message_index, CAST(block_index AS BIGINT) AS block_index, part[1] AS block_type, part[2] AS text,
             nullif(part[3], '') AS language, part[4] AS metadata_json FROM a),
m AS (SELECT conversation_id, CAST(turn AS BIGINT) AS message_index, role, CASE WHEN form IN (0, 2, 4) THEN made END AS timestamp,
             CASE form WHEN 0 THEN said WHEN 1 THEN said || chr(10) || chr(10) || '```sql' || chr(10) || 'SELECT ' || turn || chr(10) || '```'
                  WHEN 2 THEN '| ' || turn || ' |' || chr(10) || chr(10) || '{TOOL_TEXT}'
                  WHEN 3 THEN said || chr(10) || chr(10) || '[Attachment not captured: i' || turn || '.png]' || chr(10) || chr(10) || turn
                  WHEN 4 THEN said || chr(10) || chr(10) || '[Attachment not captured: a' || turn || '.pdf]' || chr(10) || chr(10) || '[Attachment not captured: file]'
             END AS text FROM y WHERE form <> 5),
v AS (SELECT conversation_id, 1 AS part, message_index, block_index, CASE block_type WHEN 'tool' THEN 'unsupported_tool_call' ELSE 'attachment_placeholder' END AS code
      FROM k WHERE block_type IN ('tool', 'attachment')
      UNION ALL SELECT conversation_id, 2, message_index, 0, 'missing_timestamp' FROM m WHERE timestamp IS NULL),
w AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY part, message_index, block_index) - 1 AS warning_index, code,
             CASE code {" ".join(f"WHEN '{c}' THEN '{t}'" for c, t in WARNINGS.items())} END AS message, message_index FROM v)"""
_JSON = (_SAYS, _FILES, _PARTS)


def _blocks(parsed: DataFrame) -> DataFrame:
    m = parsed.select("conversation_id", F.explode("parsed.messages").alias("m"))
    b = m.select("conversation_id", F.col("m.index").alias("message_index"), F.posexplode("m.blocks").alias("block_index", "b"))
    return b.select(
        "conversation_id", "message_index", F.col("block_index").cast("long").alias("block_index"), F.col("b.type").alias("block_type"), "b.text", "b.language", "b.metadata_json"
    )


def _messages(parsed: DataFrame) -> DataFrame:
    m = parsed.select("conversation_id", F.col("parsed.method").alias("method"), F.col("parsed.title").alias("title"), F.explode("parsed.messages").alias("m"))
    return m.select("conversation_id", "method", "title", F.col("m.index").alias("message_index"), "m.role", "m.timestamp", "m.text", "m.provenance_json")


def _warnings(parsed: DataFrame) -> DataFrame:
    w = parsed.select("conversation_id", F.posexplode("parsed.warnings").alias("warning_index", "w"))
    return w.select("conversation_id", F.col("warning_index").cast("long").alias("warning_index"), "w.code", "w.message", "w.message_index")


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same snapshots in the third of a page's scripts: the first is code, the second broken."""
    page = F.concat(F.lit('<html><title>Page</title><script>var a = 1</script><script type="application/json">{broken</script><script id="__NEXT_DATA__"> '), "text", F.lit("</script></html>"))
    return _snapshots(spark, sf_dir).withColumn("text", page)


def _all_messages(method: str) -> str:
    provenance = f"""'{{"source": "{method}", "raw_index": ' || message_index || '}}'"""
    return f"SELECT conversation_id, '{method}' AS method, 'Title of ' || conversation_id AS title, message_index, role, timestamp, text, {provenance} AS provenance_json FROM m"


query("structured_blocks", C._sql("SELECT * FROM k", *_JSON))(lambda s, d: _blocks(parse_snapshots(_snapshots(s, d))))
query("structured_messages", C._sql(_all_messages("json_structured_data"), *_JSON))(lambda s, d: _messages(parse_snapshots(_snapshots(s, d))))
query("structured_warnings", C._sql("SELECT * FROM w", *_JSON))(lambda s, d: _warnings(parse_snapshots(_snapshots(s, d))))
query("embedded_blocks", C._sql("SELECT * FROM k", *_JSON))(lambda s, d: _blocks(parse_snapshots(_embedded(s, d))))
query("embedded_messages", C._sql(_all_messages("embedded_structured_data"), *_JSON))(lambda s, d: _messages(parse_snapshots(_embedded(s, d))))

# rendered pages: a label line and a dated attribute; code; a table and a time element; an image in the inner of two candidates
_ARTICLES = (
    '<div class="message" data-author="{role}" data-created="{made}"><h3>You said</h3><p>{said}</p></div>',
    '<div data-message-author-role="{role}"><p>{said}<br>line</p><pre><code class="x lang-sql">SELECT {turn}</code></pre></div>',
    '<div aria-label="{role}"><table><tr><th>K</th><td>v</td></tr><tr><td>{turn}</td></tr></table><time datetime="{made}"></time></div>',
    '<section id="{role}"><article data-role="{role}"><img alt="i{turn}"><button>skip</button>{said}</article></section>',
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir)
    item = F.lit("")
    for i, form in enumerate(_ARTICLES):
        item = F.when(F.col("turn") % 4 == i, _fill_spark(form)).otherwise(item)
    rows = rows.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    return rows.select("conversation_id", F.concat(F.lit("<html><head><title> Page  of "), "conversation_id", F.lit("</title></head><body>"), body, F.lit("</body></html>")).alias("text"))


_RENDERED = f"""
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, turn % 4 AS shape,
             said || chr(10) || chr(10) || 'line' AS two, '[Attachment not captured: i' || turn || ']' AS image,
             '| K | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || turn || ' |' AS grid FROM y),
m AS (SELECT conversation_id, 'rendered_html' AS method, 'Page of ' || conversation_id AS title, place AS message_index, role,
             CASE WHEN shape IN (0, 2) THEN made END AS timestamp,
             CASE shape WHEN 0 THEN said WHEN 1 THEN two || chr(10) || chr(10) || '```sql' || chr(10) || 'SELECT ' || turn || chr(10) || '```'
                  WHEN 2 THEN grid ELSE image || chr(10) || chr(10) || said END AS text,
             '{{"source": "rendered_html", "tag": "' || CASE shape WHEN 3 THEN 'article' ELSE 'div' END || '", "raw_index": ' || place || '}}' AS provenance_json FROM i),
v AS (SELECT conversation_id, 0 AS part, NULL AS message_index, 'structured_data_not_found' AS code FROM m GROUP BY conversation_id
      UNION ALL SELECT conversation_id, 1, place, 'attachment_placeholder' FROM i WHERE shape = 3
      UNION ALL SELECT conversation_id, 2, message_index, 'missing_timestamp' FROM m WHERE timestamp IS NULL),
w AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY part, message_index) - 1 AS warning_index, code,
             CASE code {" ".join(f"WHEN '{c}' THEN '{t}'" for c, t in WARNINGS.items())} END AS message, CAST(message_index AS BIGINT) AS message_index FROM v)"""
query("rendered_messages", C._sql("SELECT * FROM m", _SAYS, _RENDERED))(lambda s, d: _messages(parse_snapshots(_pages(s, d))))
query("rendered_warnings", C._sql("SELECT * FROM w", _SAYS, _RENDERED))(lambda s, d: _warnings(parse_snapshots(_pages(s, d))))


# ingest: the same snapshots as landed files
def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _snapshots(spark, sf_dir).select(F.concat(F.lit("file:/landed/"), "conversation_id", F.lit(".json")).alias("file_path"), "text")
    return capture_frame(files, NOW)


def _ingested(table: str, *columns: str):
    return lambda s, d: ingest(_captures(s, d), F.lit(NOW))[table].selectExpr(*(columns or TABLES[table].fieldNames()))


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}-' || substring(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 32)"


_INGEST = f"""
q AS (SELECT *, 'file:/landed/' || conversation_id || '.json' AS raw_path, 'transcripts/' || conversation_id || '-20260304T050607Z.json' AS own_path FROM z),
u AS (SELECT *, {_id("art", "raw_path")} AS source_artifact_id, {_id("art", "own_path")} AS transcript_artifact_id FROM q),
g AS (SELECT *, {_id("tr", "conversation_id", "transcript_artifact_id")} AS transcript_id FROM u)"""
_FRESH = (*_JSON, _INGEST)
query(
    "ingest_raw_artifacts",
    C._sql(
        f"""SELECT source_artifact_id AS artifact_id, conversation_id, 'https://claude.ai/share/' || conversation_id AS source_url, 'source_snapshot' AS artifact_kind,
            raw_path AS file_path, 'application/json' AS media_type, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS byte_size, '{NOW}' AS captured_at FROM g
            UNION ALL SELECT transcript_artifact_id, conversation_id, 'https://claude.ai/share/' || conversation_id, 'parsed_transcript', own_path, 'application/json', NULL, NULL, '{NOW}' FROM g""",
        *_FRESH,
    ),
)(
    _ingested(
        "raw_artifacts", "artifact_id", "conversation_id", "source_url", "artifact_kind", "file_path", "media_type",
        *[f"CASE WHEN artifact_kind = 'source_snapshot' THEN {c} END AS {c}" for c in ("sha256", "byte_size")], "captured_at",
    )
)
query(
    "ingest_transcripts",
    C._sql(
        f"""SELECT transcript_id, conversation_id, 'Title of ' || conversation_id AS title, source_artifact_id, transcript_artifact_id, 'json_structured_data' AS parser_method,
            '{NOW}' AS fetched_at, coalesce(n, 0) AS message_count, coalesce(e, 0) AS warning_count, '{NOW}' AS created_at FROM g
            JOIN (SELECT conversation_id, count(*) AS n FROM m GROUP BY 1) USING (conversation_id) LEFT JOIN (SELECT conversation_id, count(*) AS e FROM w GROUP BY 1) USING (conversation_id)""",
        *_FRESH,
    ),
)(_ingested("transcripts"))
query(
    "ingest_messages",
    C._sql(
        f"""SELECT transcript_id, conversation_id, message_index, role, m.text, timestamp, '{{"source": "json_structured_data", "raw_index": ' || message_index || '}}' AS provenance_json,
            '{NOW}' AS created_at FROM m JOIN g USING (conversation_id)""",
        *_FRESH,
    ),
)(_ingested("transcript_messages"))
query(
    "ingest_blocks",
    C._sql(f"SELECT transcript_id, message_index, block_index, block_type, k.text, language, metadata_json, '{NOW}' AS created_at FROM k JOIN g USING (conversation_id)", *_FRESH),
)(_ingested("transcript_message_blocks"))
query(
    "ingest_warnings", C._sql(f"SELECT transcript_id, warning_index, code, message, message_index, '{NOW}' AS created_at FROM w JOIN g USING (conversation_id)", *_FRESH)
)(_ingested("transcript_warnings"))


@query(
    "transcript_documents",
    C._sql(
        f"""SELECT conversation_id, 'https://claude.ai/share/' || conversation_id AS url, 'claude_shared_snapshot' AS capture_method, 'json_structured_data' AS parser_method,
            '{NOW}' AS fetched_at, sha256(g.text) AS raw_sha256, 'Title of ' || conversation_id AS title, count(*) AS messages,
            sha256(string_agg(m.text, chr(10) ORDER BY message_index)) AS text_sha256 FROM g JOIN m USING (conversation_id) GROUP BY conversation_id, g.text""",
        *_FRESH,
    ),
)
def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript documents, written as JSON and read again."""
    document = F.parse_json(transcript_json(_captures(spark, sf_dir)))
    get = lambda path, kind="string": F.variant_get("j", path, kind)
    texts = F.transform(get("$.messages", "array<variant>"), lambda m: F.variant_get(m, "$.text", "string"))
    source = [get(f"$.source.{f}").alias(f) for f in ("url", "capture_method", "parser_method", "fetched_at", "raw_sha256")]
    return _captures(spark, sf_dir).select(document.alias("j")).select(
        get("$.conversation.id").alias("conversation_id"), *source, get("$.conversation.title").alias("title"),
        F.size(texts).cast("long").alias("messages"), F.sha2(F.array_join(texts, "\n"), 256).alias("text_sha256"),
    )


# extraction runs: no output, no JSON, a broken rule, or a claim per message with a quote that is or isn't there
_CLAIM = (
    '{"standalone_claim_text": "{word} is what the message says", "speaker_role": "{role}", "speech_act_type": "fact", "hedge_level": "low", "source_message_index": {turn},'
    ' "source_quote": "{quote}", "source_block_index": 0, "concept_tags": ["a", "b c"]}'
)


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.messages(spark, sf_dir).withColumn("word", F.regexp_extract("text", r"\p{L}+", 0))
    m = m.withColumn("quote", F.when(F.col("turn") % 3 == 0, "never said").otherwise(F.col("word")))
    item = F.lit(_CLAIM)
    for v in ("word", "role", "turn", "quote"):
        item = F.replace(item, F.lit("{" + v + "}"), F.col(v).cast("string"))
    runs = m.groupBy("transcript_id", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
    whole = F.concat(F.lit(' {"claims": ['), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]}\n"))
    way = F.col("conv_id") % 5
    raw = F.when(way == 1, "no claims").when(way == 2, F.replace(whole, F.lit('"low"'), F.lit('"lower"'))).when(way == 3, '{"claims": []}').otherwise(whole)
    return runs.filter(way != 0).select("transcript_id", raw.alias("raw_output"))


def _run(table: str, *columns: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = (D.transcripts(spark, sf_dir), D.messages(spark, sf_dir), D.blocks(spark, sf_dir))
        frames = run_extraction(*parts, table_extractor(_outputs(spark, sf_dir)), "table", F.lit(NOW), model="m")
        return frames[table].select(*(columns or TABLES[table].fieldNames()))

    return f


_item = f"'{_CLAIM}'"
for _v in ("word", "role", "turn", "quote"):
    _item = f"replace({_item}, '{{{_v}}}', CAST({_v} AS VARCHAR))"
_PROMPT = INSTRUCTIONS.replace("'", "''")
_ASKED = f"""
mm AS (SELECT *, regexp_extract(text, '\\pL+') AS word, CASE WHEN turn % 3 = 0 THEN 'never said' ELSE regexp_extract(text, '\\pL+') END AS quote FROM m),
pp AS (SELECT p.transcript_id, CAST(substring(p.transcript_id, 4) AS BIGINT) AS conv_id, sha256('{_PROMPT}' || chr(10) || 'Transcript:' || chr(10) || p.body) AS prompt_sha256
       FROM ({C._PROMPT}) p),
rr AS (SELECT *, {_id("run", "transcript_id", "'table'", "prompt_sha256", f"'{NOW}'")} AS run_id, conv_id % 5 AS way FROM pp),
oo AS (SELECT conv_id, count(*) AS n, ' {{"claims": [' || string_agg({_item}, ', ' ORDER BY turn) || ']}}' || chr(10) AS whole FROM mm GROUP BY conv_id),
ww AS (SELECT rr.*, n, CASE way WHEN 1 THEN 'no claims' WHEN 2 THEN replace(whole, '"low"', '"lower"') WHEN 3 THEN '{{"claims": []}}' WHEN 4 THEN whole END AS raw
       FROM rr JOIN oo USING (conv_id))"""
_ASK = (C._MESSAGES, _ASKED)
query(
    "extraction_runs_written",
    C._sql(
        f"""SELECT run_id, transcript_id, 'table' AS extractor_name, 's1-009-v2' AS prompt_version, prompt_sha256, 'm' AS model,
            CASE WHEN way < 3 THEN 'failed' ELSE 'succeeded' END AS status, CASE way WHEN 0 THEN 'Extractor raised LookupError: no output'
              WHEN 1 THEN 'Extraction output failed contract validation: Output is not valid JSON: Expecting value: line 1 column 1 (char 0)'
              WHEN 2 THEN left('Extraction output failed contract validation: ' || array_to_string(list_transform(range(n), lambda i: 'claims[' || i || ']: invalid hedge_level ''lower''.'), '; '), 2000)
            END AS error_message, n AS input_message_count, CASE way WHEN 4 THEN n ELSE 0 END AS output_claim_count, '{NOW}' AS started_at, '{NOW}' AS completed_at, '{NOW}' AS created_at FROM ww""",
        *_ASK,
    ),
)(_run("extraction_runs"))
query(
    "extraction_outputs_written",
    C._sql(
        f"""SELECT run_id, 'extractions/' || transcript_id || '-' || run_id || '.json' AS file_path, sha256(trim(raw, ' ' || chr(10)) || chr(10)) AS sha256,
            CAST(strlen(trim(raw, ' ' || chr(10)) || chr(10)) AS BIGINT) AS byte_size, '{NOW}' AS created_at FROM ww WHERE way IN (2, 3, 4)""",
        *_ASK,
    ),
)(_run("extraction_outputs"))
_MADE = f"""
c AS (SELECT ww.run_id, {_id("claim", "ww.run_id", "CAST(turn AS VARCHAR)")} AS claim_id, mm.transcript_id, conversation_id, CAST(turn AS BIGINT) AS claim_sequence,
             word || ' is what the message says' AS claim, role AS speaker_role, CAST(NULL AS VARCHAR) AS speaker_label, 'fact' AS speech_act_type, 'low' AS hedge_level,
             message_index AS source_message_index, CAST(0 AS BIGINT) AS source_block_index, CAST(NULL AS BIGINT) AS source_char_start, CAST(NULL AS BIGINT) AS source_char_end,
             quote, timestamp AS source_timestamp, '["a", "b c"]' AS concept_tags_json, CAST(NULL AS VARCHAR) AS supersedes_claim_id, '{NOW}' AS created_at, text AS source
      FROM mm JOIN ww USING (conv_id) WHERE way = 4)"""
query("extraction_claims_written", C._sql(f"SELECT {C._C} FROM r", *_ASK, _MADE, C._VERDICTS))(_run("claim_ledger"))
query(
    "extraction_checks_written",
    C._sql(
        f"SELECT {_id('check', 'claim_id')} AS check_id, claim_id, run_id, support_verdict, check_method, quote_found, fallback_applied, original_claim_text, detail, created_at FROM r",
        *_ASK, _MADE, C._VERDICTS,
    ),
)(_run("claim_support_checks"))

# lines for people, and small functions
query(
    "claim_lines",
    C._sql(
        """SELECT '[' || claim_id || '] ' || speaker_role || ' ' || speech_act_type || '/' || hedge_level || ': ' || standalone_claim_text || ' (message ' || source_message_index
           || CASE WHEN source_block_index IS NULL THEN '' ELSE ', block ' || source_block_index || ', chars ' || source_char_start || '-' || source_char_end END || ')' AS line FROM r""",
        C._MESSAGES, C._CLAIMS,
    ),
)(lambda s, d: cli.claim_lines(L.list_claims(D.tables(s, d))))
query(
    "transcript_lines",
    C._sql(
        "SELECT '[' || transcript_id || '] ' || conversation_id || ' ' || coalesce(title, '(untitled)') || ' messages=' || message_count || ' warnings=0' AS line FROM t",
        C._MESSAGES, C._TRANSCRIPTS,
    ),
)(lambda s, d: cli.transcript_lines(L.list_transcripts(D.tables(s, d))))
query(
    "run_lines",
    C._sql(
        "SELECT '[' || run_id || '] ' || transcript_id || ' rule ' || status || ' claims=' || output_claim_count || coalesce(' error=' || error_message, '') AS line FROM x",
        C._MESSAGES, C._TRANSCRIPTS, C._RUNS,
    ),
)(lambda s, d: cli.run_lines(L.list_extraction_runs(D.tables(s, d))))
query(
    "run_summary",
    C._sql(
        """SELECT x.run_id, x.transcript_id, status, output_claim_count, error_message, said AS verdicts, fallbacks FROM x
           LEFT JOIN (SELECT run_id, string_agg(support_verdict || '=' || n, ',' ORDER BY support_verdict) AS said FROM
                      (SELECT run_id, support_verdict, count(*) AS n FROM h GROUP BY ALL) GROUP BY run_id) USING (run_id)
           LEFT JOIN (SELECT run_id, CAST(sum(fallback_applied) AS BIGINT) AS fallbacks FROM h GROUP BY run_id) USING (run_id)""",
        C._MESSAGES, C._TRANSCRIPTS, C._CLAIMS, C._CHECKS, C._RUNS,
    ),
)(
    lambda s, d: cli.outcome(D.tables(s, d)).select(
        "run_id", "transcript_id", "status", "output_claim_count", "error_message",
        F.array_join(F.transform("support_verdicts", lambda v: F.concat(v["support_verdict"], F.lit("="), v["n"].cast("string"))), ",").alias("verdicts"), "fallbacks",
    )
)
query(
    "snapshot_api_urls",
    "SELECT p_partkey, 'https://claude.ai/api/chat_snapshots/' || url_encode(p_name || '/é~*') || '?rendering_mode=messages&render_all_tools=true' AS url FROM part",
)(lambda s, d: D.read(s, d, "part").select("p_partkey", snapshot_api_url(F.concat("p_name", F.lit("/é~*"))).alias("url")))
query(
    "time_stamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad('' || (CAST(date_part('millisecond', ts) AS INTEGER) % 1000), 3, '0') || 'Z' AS millis,
       replace(replace(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '-', ''), ':', '') AS file FROM events""",
)(lambda s, d: D.read(s, d, "events").select("event_id", X.stamp(F.col("ts")).alias("seconds"), X.stamp_ms(F.col("ts")).alias("millis"), X.file_stamp(X.stamp(F.col("ts"))).alias("file")))
