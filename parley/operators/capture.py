"""Landing of shared snapshots through a pluggable fetcher: URLs become raw rows, and those captures.

Nothing here knows a network. A fetcher is a Python function from a URL to its text that runs on the executors; what it
raises is the failure of that URL only. The public snapshot API is asked first, the page itself where that gives no JSON.
Raw text is written before it is parsed, so what can't be parsed is still there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.urls import SHARE_HOSTS, share_url_gate, snapshot_api_url

Fetcher = Callable[[str], str]

# What is said of a snapshot that can't be landed.
URL_ERRORS = {"scheme": "The share URL must use https.", "host": "The share URL's host is not supported.", "path": "The share URL must look like /share/<id>."}
CHALLENGED = "the snapshot API gave a challenge page"
NO_JSON = "the snapshot API gave no JSON"
ONLY_SHELL = "Only the web app shell was served, and the snapshot API was no help"


def is_guarded(text: str) -> bool:
    """``text.is_challenge`` where a fetcher runs."""
    return all(mark in text.lower() for mark in X.CHALLENGE_MARKS)


def decode_body(body: bytes, charset: str | None = None) -> str:
    """Text of a response; what can't be decoded is replaced."""
    return body.decode(charset or "utf-8", errors="replace")


def fetched(urls: DataFrame, fetch: Fetcher, hosts: tuple[str, ...] = SHARE_HOSTS) -> DataFrame:
    """(url, conversation_id, text, error) for each of ``urls`` (url): the gate's error, the fetcher's, or the text."""
    gated = urls.select("url", share_url_gate(F.col("url"), hosts).alias("gate"))
    asked = gated.select("url", F.col("gate.conversation_id").alias("conversation_id"), F.col("gate.url").alias("page"), "gate.error")
    asked = asked.withColumn("api", snapshot_api_url(F.col("conversation_id"), hosts[0]))

    def attempt(url: str) -> tuple[str | None, str | None]:
        try:
            return fetch(url), None
        except Exception as e:  # whatever a client raises is this URL's failure
            return None, str(e) or type(e).__name__

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for url, key, page, error, api in f.itertuples(index=False):
                first = second = first_error = second_error = None
                if error is None:
                    first, first_error = attempt(api)
                    if first is None or is_guarded(first) or first.lstrip()[:1] not in ("{", "["):
                        second, second_error = attempt(page)
                rows.append((url, key, error, first, first_error, second, second_error))
            yield pd.DataFrame(rows, columns=["url", "conversation_id", "gate", "first", "first_error", "second", "second_error"], dtype=object)

    schema = "url string, conversation_id string, gate string, first string, first_error string, second string, second_error string"
    told = asked.select("url", "conversation_id", "page", "error", "api").mapInPandas(task, schema)
    is_json = F.coalesce(X.sniff_format(F.col("first")) == "json", F.lit(False)) & ~F.coalesce(X.is_challenge(F.col("first")), F.lit(False))
    why = F.coalesce("first_error", F.when(X.is_challenge(F.col("first")), CHALLENGED).otherwise(NO_JSON))
    gate = F.element_at(F.create_map(*[F.lit(x) for pair in URL_ERRORS.items() for x in pair]), F.col("gate"))
    error = (
        F.when(F.col("gate").isNotNull(), gate)
        .when(is_json, F.lit(None))
        .when(F.col("second_error").isNotNull(), F.col("second_error"))
        .when(X.is_app_shell(F.col("second")), F.concat(F.lit(ONLY_SHELL + " ("), why, F.lit(").")))
    )
    text = F.when(F.col("gate").isNull() & is_json, F.col("first")).when(error.isNull(), F.col("second"))
    return told.select("url", "conversation_id", text.alias("text"), error.alias("error"))


def land(urls: DataFrame, fetch: Fetcher, fetched_at: str, root: str, hosts: tuple[str, ...] = SHARE_HOSTS) -> tuple[DataFrame, DataFrame]:
    """Fetch once, write ``<root>/raw/stamp=<time>``, and return landed files (file_path, text, url) and failures (url, error).

    A stamp that is there already is read, not fetched again.
    """
    stamp = fetched_at.translate(str.maketrans("", "", "-:."))
    path = f"{root}/raw/stamp={stamp}"
    fetched(urls, fetch, hosts).write.mode("ignore").parquet(path)
    rows = urls.sparkSession.read.parquet(path)
    name = F.concat(F.lit(f"{root}/raw/"), "conversation_id", F.lit(f"-{stamp}."), X.sniff_format(F.col("text")))
    return rows.filter("error is null").select(name.alias("file_path"), "text", "url", "conversation_id"), rows.filter("error is not null").select("url", "error")
