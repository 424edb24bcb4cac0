"""Contract, support check, extraction runs and the append-only store, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from parley import cli
from parley.operators.capture import URL_ERRORS, decode_body, land
from parley.operators.contract import validate
from parley.operators.extract import callable_extractor, run_extraction, table_extractor, unwrap_completion
from parley.operators.citation import lexical_check
from parley.plans import ledger as L
from parley.schemas import TABLES
from parley.streaming.captures import append_captures, stream_captures

FIRST = "Rye bread keeps longer, so bake two loaves on Friday."
REPLY = "Two loaves need a kilo of rye flour. Start the sour on Thursday night."
LAST = "How warm should the kitchen be for it?"
SNAPSHOT = {
    "title": "Baking",
    "turns": [
        {"role": "user", "text": FIRST},
        {"role": "assistant", "parts": [REPLY, {"lang": "text", "value": "1000 g"}], "timestamp": "2031-02-03T04:05:06Z"},
        {"role": "user", "body": LAST},
    ],
}


def claim(**more):
    base = {
        "standalone_claim_text": "Two loaves of rye bread should be baked on Friday.",
        "speaker_role": "user",
        "speech_act_type": "plan",
        "hedge_level": "none",
        "source_message_index": 0,
        "source_quote": "bake two loaves on Friday",
    }
    return base | more


def pointed(quote, **more):
    """A claim about words of the reply's first block, by their place."""
    at = REPLY.index(quote)
    return claim(
        standalone_claim_text=quote, speaker_role="assistant", speech_act_type="instruction", source_message_index=1, source_block_index=0, source_char_start=at,
        source_char_end=at + len(quote), source_quote=quote, **more,
    )


GOOD = [
    pointed("Start the sour on Thursday night.", concept_tags=["sour dough", "time"]),
    claim(standalone_claim_text="The user wonders what temperature the kitchen needs.", speech_act_type="question", source_message_index=2, source_quote=LAST, speaker_label=None),
    claim(standalone_claim_text="Rye bread keeps longer than wheat bread.", speech_act_type="fact", hedge_level="low", source_quote="Rye bread keeps longer", concept_tags=None),
    claim(speech_act_type="plan"),
]
NOW = "2026-07-07T10:00:00Z"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A ledger with one capture."""
    ledger = L.Ledger(spark, tmp_path_factory.mktemp("ledger").as_uri())
    files = spark.createDataFrame([("file:/raw/conv1.json", json.dumps(SNAPSHOT)), ("file:/raw/bad.html", "<p>nothing</p>")], "file_path string, text string")
    assert append_captures(ledger, files, "b1", NOW)
    return ledger


def extraction(store, outputs, name="file", **more):
    t = store.tables()
    return run_extraction(t["transcripts"], t["transcript_messages"], t["transcript_message_blocks"], outputs, name, F.lit(NOW), **more)


def test_ingest(store):
    t = store.tables()
    assert {n: t[n].count() for n in TABLES} == {
        "raw_artifacts": 2, "transcripts": 1, "transcript_messages": 3, "transcript_message_blocks": 4, "transcript_warnings": 2,
        "extraction_runs": 0, "claim_ledger": 0, "claim_support_checks": 0, "extraction_outputs": 0,
    }
    row = L.list_transcripts(t, conversation_id="conv1").first()
    assert (row["message_count"], row["warning_count"], row["parser_method"]) == (3, 2, "json_structured_data")
    assert [r["role"] for r in L.list_transcript_messages(t, row["transcript_id"]).collect()] == ["user", "assistant", "user"]
    with pytest.raises(L.QueryError):
        L.get_transcript(t, "tr-none")


def test_filters_reach_the_scan(store):
    plan = L.list_transcripts(store.tables(), conversation_id="conv1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(conversation_id,conv1)" in plan and "transcript_messages" not in plan
    plan = L.list_transcript_messages(store.tables(), "tr-1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(transcript_id,tr-1)" in plan


def test_replay_and_duplicates(spark, store):
    files = spark.createDataFrame([("file:/raw/conv1.json", json.dumps(SNAPSHOT))], "file_path string, text string")
    assert not append_captures(store, files, "b1", NOW)  # the batch is there
    assert append_captures(store, files, "b1-again", NOW)  # known files are left out
    assert store.table("transcripts").count() == 1
    broken = store.table("raw_artifacts").limit(1).withColumn("artifact_id", F.lit("art-new"))
    with pytest.raises(L.DuplicateArtifactError):
        store.append("dup", {"raw_artifacts": broken})
    assert store.table("raw_artifacts").count() == 2  # what was rejected doesn't count


def test_no_updates(store):
    for table, word in (("transcripts", "immutable"), ("claim_ledger", "append-only")):
        for f in (store.update, store.delete, store.overwrite):
            with pytest.raises(L.LedgerError, match=f"{table} is {word}"):
                f(table)


def test_run_to_ledger_and_queries(spark, store, capsys, tmp_path):
    frames = extraction(store, callable_extractor(lambda prompt: json.dumps({"claims": GOOD})))
    assert store.append("run1", frames)
    t = store.tables()
    claims = L.list_claims(t).collect()
    assert [c["claim_sequence"] for c in claims] == [0, 1, 2, 3]
    assert claims[0]["concept_tags_json"] == '["sour dough", "time"]' and claims[2]["concept_tags_json"] == "[]"
    checks = {r["support_verdict"]: r["n"] for r in t["claim_support_checks"].groupBy("support_verdict").agg(F.count("*").alias("n")).collect()}
    assert checks == {"yes": 1, "partial": 2, "no": 1}
    assert t["claim_support_checks"].agg(F.sum("fallback_applied")).first()[0] == 1
    assert claims[1]["standalone_claim_text"] == LAST  # too few of its words were said
    found = L.get_claim_source(t, claims[0]["claim_id"])
    assert found["source_block"]["text"] == REPLY and found["source_message"]["message_index"] == 1
    assert "source_block" not in L.get_claim_source(t, claims[3]["claim_id"])
    assert L.list_claims(t, speaker_role="user", speech_act_type="question").count() == 1
    assert L.list_claims(t, conversation_id="none").count() == 0
    for bad in ({"speaker_role": "visitor"}, {"speech_act_type": "opinion"}):
        with pytest.raises(L.QueryError):
            L.list_claims(t, **bad)
    with pytest.raises(L.QueryError):
        L.list_support_checks(t, support_verdict="maybe")
    run = L.list_extraction_runs(t).first()
    assert run["status"] == "succeeded" and run["raw_output_path"].startswith("extractions/") and run["output_claim_count"] == 4
    assert L.current_claims(t).count() == 4
    assert cli.main(["--ledger", store.path, "query", "claims", "--speech-act", "question"], spark) == 0
    assert "message 2" in capsys.readouterr().out
    assert cli.main(["--ledger", store.path, "query", "transcripts", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["conversation_id"] == "conv1"
    assert cli.main(["--ledger", store.path, "query", "claims", "--speaker", "nobody"], spark) == 1
    path = tmp_path / "claims.json"
    path.write_text(json.dumps({"claims": GOOD[:1]}))
    assert cli.main(["--ledger", store.path, "extract", "--claims-json", str(path), "--batch", "run2", "--started-at", "2026-07-08T10:00:00Z"], spark) == 0
    assert "succeeded 1" in capsys.readouterr().out


def test_cli_run(spark, tmp_path, capsys):
    folder, claims = tmp_path / "in", tmp_path / "claims.json"
    folder.mkdir()
    (folder / "conv5.json").write_text(json.dumps(SNAPSHOT))
    claims.write_text(json.dumps({"claims": GOOD[3:]}))
    base = ["--ledger", (tmp_path / "ledger").as_uri()]
    assert cli.main([*base, "init"], spark) == 0
    assert cli.main([*base, "query", "claims"], spark) == 0
    assert cli.EMPTY in capsys.readouterr().out
    run = ["run", str(folder), "--batch", "b", "--fetched-at", NOW, "--claims-json", str(claims), "--started-at", NOW]
    assert cli.main([*base, *run], spark) == 0
    assert cli.main([*base, "extract", "--transcript", "tr-none", "--batch", "c", "--claims-json", str(claims), "--started-at", NOW], spark) == 1
    assert "Unknown transcript_id" in capsys.readouterr().out
    assert cli.main([*base, "query", "runs"], spark) == 0
    assert "succeeded claims=1" in capsys.readouterr().out
    assert cli.main(["check-url", "http://x"], spark) == 1


def pages():
    """A fetcher over a few pages; made here, so that it travels to the executors by value."""
    api = "https://claude.ai/api/chat_snapshots/{}?rendering_mode=messages&render_all_tools=true".format
    known = {
        api("kites"): json.dumps(SNAPSHOT), api("page%20two"): "<p>no JSON</p>", "https://claude.ai/share/page two": "<div data-role='user'>Only a page.</div>",
        api("guarded"): "{Just a moment ... challenges.cloudflare.com", "https://claude.ai/share/guarded": '<div id="root"></div><script src="claude-ai.js"></script>', api("dumb"): "[]",
    }

    def fetch(url):
        if url not in known:
            raise LookupError(f"no page {url[-20:]}")
        return known[url]

    return fetch


def test_capture(spark, tmp_path):
    urls = [f"https://claude.ai/share/{x}" for x in ("kites", "page two", "guarded", "gone", "dumb")] + ["http://claude.ai/share/x", "https://else.org/share/x", "https://claude.ai/x"]
    files, failed = land(spark.createDataFrame([(u,) for u in urls], "url string"), pages(), NOW, tmp_path.as_uri())
    errors = {r["url"]: r["error"] for r in failed.collect()}
    assert errors == {
        urls[2]: "Only the web app shell was served, and the snapshot API was no help (the snapshot API gave a challenge page).",
        urls[3]: "no page claude.ai/share/gone", **dict(zip(urls[5:], URL_ERRORS.values(), strict=True)),
    }
    landed = {r["conversation_id"]: r for r in files.collect()}
    assert set(landed) == {"kites", "page two", "dumb"} and landed["kites"]["file_path"].endswith("/raw/kites-20260707T100000Z.json")
    assert landed["page two"]["file_path"].endswith(".html") and landed["dumb"]["text"] == "[]"  # kept, though nothing can be parsed
    again, _ = land(spark.createDataFrame([(urls[3],)], "url string"), pages(), NOW, tmp_path.as_uri())
    assert again.count() == 3  # the stamp is there
    assert decode_body("é".encode("latin-1"), "latin-1") == "é" and decode_body(b"a\xff") == "a\ufffd"


def test_cli_capture_and_run(spark, tmp_path, capsys):
    fetch, good = pages(), GOOD[:2]

    def transport(config, body):
        request = json.loads(body)
        if "Baking" not in request["messages"][0]["content"]:
            raise TimeoutError("slow")
        assert (request["model"], config.api_key, config.base_url) == ("m/1", "secret", "https://models.example.org")
        return json.dumps({"choices": [{"message": {"content": "```json\n" + json.dumps({"claims": good}) + "\n```"}}]})

    env = tmp_path / "env"
    env.write_text("OPENROUTER_API_KEY=secret\nOPENROUTER_BASE_URL=https://models.example.org/\n")
    base = ["--ledger", (tmp_path / "ledger").as_uri(), "--env-file", str(env)]
    assert cli.main([*base, "init"], spark) == 0 and "claim_ledger" in capsys.readouterr().out
    assert cli.main([*base, "init"], spark) == 0 and "nothing" in capsys.readouterr().out
    one = ["--url", "https://claude.ai/share/kites", "--fetched-at", NOW]
    run = ["run", "--batch", "u", *one, "--started-at", NOW]
    for wrong in (run, [*run, "--model", "m/1"]):  # no model, no transport: nothing is captured
        assert cli.main([*base, *wrong], spark, fetch) == 1
    assert cli.main([*base, "capture", "--batch", "c", *one], spark) == 1  # no fetcher
    assert cli.main([*base, "query", "transcripts"], spark) == 0 and cli.EMPTY in capsys.readouterr().out
    assert cli.main([*base, *run, "--model", "m/1"], spark, fetch, transport) == 0
    assert "succeeded 2" in capsys.readouterr().out
    later = "2026-07-08T10:00:00Z"
    two = ["--url", "https://claude.ai/share/page two", "--fetched-at", later]
    assert cli.main([*base, "run", "--batch", "v", *two, "--started-at", later, "--model", "m/1"], spark, fetch, transport) == 1
    assert cli.main([*base, "capture", "--batch", "w", "--url", "https://claude.ai/share/none", "--fetched-at", "2026-07-09T10:00:00Z"], spark, fetch) == 1
    assert '"error": "no page' in capsys.readouterr().out
    t = L.Ledger(spark, (tmp_path / "ledger").as_uri()).tables()
    runs = {r["started_at"]: r for r in L.list_extraction_runs(t).collect()}
    assert (runs[NOW]["model"], runs[NOW]["extractor_name"], runs[NOW]["output_claim_count"]) == ("m/1", "model", 2)
    assert runs[later]["error_message"] == "Extractor raised TimeoutError: slow" and len(runs) == 2
    assert {r["source_url"] for r in t["raw_artifacts"].collect()} == {"https://claude.ai/share/kites", "https://claude.ai/share/page two"}


def test_lookups_open_one_bucket(store):
    t = store.tables()
    found = L.list_transcripts(t, conversation_id="conv1")
    assert found.count() == 1 and L.list_transcripts(t, conversation_id="none").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    key = found.first()["transcript_id"]
    assert L.list_transcript_messages(t, key).count() == 3 and L.list_message_blocks(t, key).count() == 4


def test_rejected_batches_leave_no_files_and_writers_meet(spark, store, monkeypatch):
    import os

    root = store.path.removeprefix("file://").removeprefix("file:")
    before = {t: set(os.listdir(f"{root}/{t}")) for t in ("transcripts", "raw_artifacts")}
    bad = store.table("transcripts").withColumn("transcript_id", F.lit("tr-x")).withColumn("source_artifact_id", F.lit("none"))
    with pytest.raises(L.LedgerError, match="references:raw_artifacts"):
        store.append("bad", {"transcripts": bad})
    assert {t: set(os.listdir(f"{root}/{t}")) for t in before} == before
    rows = store.table("raw_artifacts").limit(1).withColumn("artifact_id", F.lit("art-both")).withColumn("file_path", F.lit("f"))
    commit, other = L.Ledger._commit, L.Ledger(spark, store.path)

    def late(self, *args):
        """The other writer commits between this one's checks and its commit."""
        monkeypatch.setattr(L.Ledger, "_commit", commit)
        assert other.append("other", {"raw_artifacts": rows})
        return commit(self, *args)

    monkeypatch.setattr(L.Ledger, "_commit", late)
    with pytest.raises(L.DuplicateArtifactError):
        store.append("mine", {"raw_artifacts": rows})
    assert store.table("raw_artifacts").filter("artifact_id = 'art-both'").count() == 1


def outcome(spark, store, raw):
    t = store.tables()
    key = t["transcripts"].first()["transcript_id"]
    frames = extraction(store, table_extractor(spark.createDataFrame([(key, raw)], "transcript_id string, raw_output string")))
    return frames, frames["extraction_runs"].first()


def test_failed_runs(spark, store):
    def fail(prompt):
        raise RuntimeError("no model")

    run = extraction(store, callable_extractor(fail))["extraction_runs"].first()
    assert (run["status"], run["error_message"], run["output_claim_count"]) == ("failed", "Extractor raised RuntimeError: no model", 0)
    frames, run = outcome(spark, store, '{"claims": []} x')
    assert run["status"] == "failed" and "not valid JSON" in run["error_message"]
    frames, run = outcome(spark, store, json.dumps({"claims": [GOOD[0], claim(hedge_level="huge")]}))
    assert run["status"] == "failed" and "claims[1]: invalid hedge_level 'huge'." in run["error_message"]
    assert frames["claim_ledger"].count() == 0 and frames["extraction_outputs"].count() == 1
    frames, run = outcome(spark, store, '{"claims": []}')
    assert run["status"] == "succeeded" and run["output_claim_count"] == 0


def test_unsupported_quote_falls_back(spark, store):
    frames, _ = outcome(spark, store, json.dumps({"claims": [claim(source_quote="never said")]}))
    check, row = frames["claim_support_checks"].first(), frames["claim_ledger"].first()
    assert (check["support_verdict"], check["quote_found"], check["fallback_applied"]) == ("no", 0, 1)
    assert row["standalone_claim_text"] == row["source_quote"] == FIRST


def test_own_checker(spark, store):
    def unsure(claim, quote, source):
        return F.struct(F.lit("unknown").alias("verdict"), F.lit(True).alias("quote_found"), F.lit("").alias("detail"), F.lit("own").alias("method"))

    t = store.tables()
    key = t["transcripts"].first()["transcript_id"]
    outputs = table_extractor(spark.createDataFrame([(key, json.dumps({"claims": GOOD}))], "transcript_id string, raw_output string"))
    frames = extraction(store, outputs, checker=unsure)
    assert all(r["standalone_claim_text"] == r["source_quote"] for r in frames["claim_ledger"].collect())
    assert frames["claim_support_checks"].filter("fallback_applied = 1 and check_method = 'own'").count() == 4


MESSAGE = ("tr", [(0, "user", "Hello you there", None, [(0, "text", "Hello", None)]), (1, "unknown", "x", None, [])])
RULES = [
    ("x", "claims[0]: claim must be a JSON object."),
    (claim(extra=1, b=2), "claims[0]: unexpected fields ['b', 'extra']"),
    ({"source_quote": "x"}, "claims[0]: missing required fields ['hedge_level', 'source_message_index', 'speaker_role', 'speech_act_type', 'standalone_claim_text']"),
    (claim(standalone_claim_text=" \t", source_quote=3), "claims[0]: standalone_claim_text must be a non-empty string.; claims[0]: source_quote must be a non-empty string."),
    (claim(speaker_role=None), "claims[0]: invalid speaker_role None."),
    (claim(speech_act_type=True), "claims[0]: invalid speech_act_type True."),
    (claim(hedge_level=7), "claims[0]: invalid hedge_level 7."),
    (claim(source_message_index=True), "claims[0]: source_message_index must be an integer."),
    (claim(source_message_index=1.0), "claims[0]: source_message_index must be an integer."),
    (claim(source_message_index=9), "claims[0]: source_message_index 9 is not in the transcript."),
    (claim(speaker_role="system"), "claims[0]: speaker_role 'system' does not match source message role 'user'."),
    (claim(source_message_index=1, speaker_role="system"), None),
    (claim(source_block_index="0"), "claims[0]: source_block_index must be an integer."),
    (claim(source_block_index=1), "claims[0]: source_block_index 1 is not in message 0."),
    (claim(source_char_start=0), "claims[0]: source_char_start and source_char_end must be provided together."),
    (claim(source_char_start=0, source_char_end="5"), "claims[0]: character offsets must be integers."),
    (claim(source_char_start=3, source_char_end=3), "claims[0]: character offsets [3, 3) are out of range for the source text."),
    (claim(source_block_index=0, source_char_start=0, source_char_end=9), "claims[0]: character offsets [0, 9) are out of range for the source text."),
    (claim(source_block_index=5, source_char_start=6, source_char_end=9, source_quote="you"), "claims[0]: source_block_index 5 is not in message 0."),
    (claim(source_char_start=0, source_char_end=5), "claims[0]: character offsets do not reproduce source_quote."),
    (claim(source_char_start=0, source_char_end=5, source_quote="Hello"), None),
    (claim(concept_tags=["a", " "]), "claims[0]: concept_tags must be a list of non-empty strings."),
    (claim(concept_tags="a"), "claims[0]: concept_tags must be a list of non-empty strings."),
    (claim(speaker_label=""), "claims[0]: speaker_label must be a non-empty string when set."),
    (claim(speaker_label=None, concept_tags=None, source_block_index=None, source_char_start=None, source_char_end=None), None),
]


def test_contract_rules(spark):
    nested = spark.createDataFrame([MESSAGE], "transcript_id string, messages array<struct<index:bigint,role:string,text:string,timestamp:string,blocks:array<struct<block_index:bigint,type:string,text:string,language:string>>>>")
    rows = [(f"r{i:02}", "tr", json.dumps({"claims": [c]})) for i, (c, _) in enumerate(RULES)]
    rows += [("top", "tr", '{"claims": 3, "b": 1, "a": 2}'), ("list", "tr", "[]"), ("none", "tr", None)]
    runs, claims = validate(spark.createDataFrame(rows, "run_id string, transcript_id string, raw_output string"), nested)
    got = {r["run_id"]: r["error_message"] for r in runs.collect()}
    head = "Extraction output failed contract validation: "
    for i, (_, want) in enumerate(RULES):
        assert got[f"r{i:02}"] == (None if want is None else head + want), RULES[i]
    assert got["top"] == head + "Unexpected top-level keys: ['a', 'b']; Output must contain a \"claims\" list."
    assert got["list"] == head + "Output JSON must be an object."
    assert got["none"].startswith(head + "Output is not valid JSON")
    assert claims.count() == 3


def test_lexical_check(spark):
    rows = [
        ("A b", "q", " \t", "unknown", False), ("A b", "zzz", "Alpha beta", "no", False), ("the of", "Alpha", "Alpha beta", "unknown", True),
        ("alpha beta gamma delta", "ALPHA  beta", "Alpha\nbeta gamma", "yes", True), ("alpha beta gamma", "alpha", "alpha beta", "partial", True),
        ("alpha beta gamma", "alpha", "alpha", "no", True), ("a", "a", None, "unknown", False),
    ]
    df = spark.createDataFrame(rows, "c string, q string, s string, v string, f boolean")
    for r in df.select("v", "f", lexical_check(F.col("c"), F.col("q"), F.col("s")).alias("g")).collect():
        assert (r["g"]["verdict"], r["g"]["quote_found"]) == (r["v"], r["f"])


def test_unwrap_completion(spark):
    bodies = [
        ('{"choices":[{"finish_reason":"stop","message":{"content":"```json\\n{}\\n```"}}]}', "{}", None),
        ('{"error":{"message":"busy"}}', None, "LLM API returned an error: busy"),
        ('{"choices":[]}', None, "LLM API response for model 'm' contained no choices."),
        ('{"choices":["x"]}', None, "LLM API response choice must be an object."),
        ('{"choices":[{"finish_reason":"length","message":{"content":"x"}}]}', None, "Model 'm' output was truncated at the max_tokens limit; the extraction JSON is incomplete."),
        ('{"choices":[{"message":{"content":" "}}]}', None, "LLM API response for model 'm' contained no message content."),
        ("nope", None, "LLM API returned a non-JSON response body."),
    ]
    df = spark.createDataFrame([(b[0],) for b in bodies], "b string").select(unwrap_completion(F.col("b"), "m").alias("r"))
    assert [(r["r"]["content"], r["r"]["error"]) for r in df.collect()] == [b[1:] for b in bodies]


def test_violations(spark, store):
    t = store.tables()
    bad = t["transcript_messages"].withColumn("role", F.lit("nobody")).withColumn("transcript_id", F.lit("tr-gone"))
    found = {r["rule"]: r["n"] for r in L.violations("transcript_messages", bad, t).collect()}
    assert found == {"check:role": 3, "references:transcripts(transcript_id)": 3}


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "conv9.json").write_text(json.dumps(SNAPSHOT))
    ledger = L.Ledger(spark, (tmp_path / "ledger").as_uri())
    for _ in range(2):  # the second run finds nothing new
        q = stream_captures(spark, str(folder), ledger, str(tmp_path / "check"), NOW)
        q.awaitTermination(120)
        assert q.exception() is None
        assert ledger.table("transcripts").count() == 1


def test_config():
    env = {"OPENROUTER_API_KEY": "k", "OPENROUTER_BASE_URL": "https://x/"}
    assert cli.model_config("m", env).base_url == "https://x"
    with pytest.raises(ValueError):
        cli.model_config(None, env)
    env = {"A": "", "B": "kept"}
    cli.load_dotenv("# c\nA='1'\nB=2\nbad\n", env)
    assert env == {"A": "1", "B": "kept"}
