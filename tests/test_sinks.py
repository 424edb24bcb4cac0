"""Documents written and read again."""

import json

from parley.sources.sinks import read_transcripts, write_outputs, write_raw, write_transcripts
from parley.streaming.captures import capture_frame

SNAPSHOT = json.dumps({"title": "T", "messages": [{"role": "user", "content": "hé\n\nthere"}, {"role": "assistant", "content": "yes", "created_at": "2026-01-01"}]})


def test_round_trip(spark, tmp_path):
    root = tmp_path.as_uri()
    files = spark.createDataFrame([("file:/a/c1.json", SNAPSHOT), ("file:/a/c2.html", "<p>x</p>")], "file_path string, text string")
    frame = capture_frame(files, "2026-07-07T10:00:00Z")
    write_transcripts(frame, root)
    row = read_transcripts(spark, root).collect()
    assert len(row) == 1 and row[0]["ready"] and row[0]["conversation"]["title"] == "T"
    assert [m["text"] for m in row[0]["messages"]] == ["hé\n\nthere", "yes"] and row[0]["source"]["parser_method"] == "json_structured_data"
    raw = files.selectExpr("'c' AS conversation_id", "'2026-07-07T10:00:00Z' AS fetched_at", "text")
    write_raw(raw, root)
    found = {r["format"]: r for r in spark.read.parquet(f"{root}/raw").collect()}
    assert found["json"]["text"] == SNAPSHOT and found["html"]["stamp"] == "20260707T100000Z"
    write_outputs(spark.createDataFrame([("r", "extractions/r.json", " {} \n")], "run_id string, file_path string, contents string"), root)
    assert spark.read.parquet(f"{root}/extractions").first()["contents"] == "{}\n"
