"""The share-URL gate as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Hosts whose share links are accepted, unless others are given.
SHARE_HOSTS = ("claude.ai", "www.claude.ai")


def url_parts(url: Column) -> dict[str, Column]:
    """scheme and host in lower case, host without user and port, path without parameters."""
    u = strip(F.coalesce(url, F.lit("")))
    place = F.regexp_extract(u, r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return {
        "url": u,
        "scheme": F.lower(F.regexp_extract(u, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1)),
        "host": F.lower(F.regexp_extract(F.regexp_replace(place, r"(?s)\A.*@", ""), r"(?s)\A([^:]*)", 1)),
        "path": F.regexp_replace(F.regexp_extract(u, r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r";[^/]*\z", ""),
    }


def share_url_gate(url: Column, hosts: tuple[str, ...] = SHARE_HOSTS, first: str = "share") -> Column:
    """Struct (url, conversation_id, error): error is scheme, host or path, in this order, or null if the link is fine."""
    p = url_parts(url)
    parts = F.filter(F.split(p["path"], "/"), lambda x: x != "")
    error = (
        F.when(p["scheme"] != "https", "scheme")
        .when(~p["host"].isin(*hosts), "host")
        .when((F.size(parts) != 2) | (F.coalesce(F.get(parts, F.lit(0)), F.lit("")) != first), "path")
    )
    return F.struct(p["url"].alias("url"), F.when(error.isNull(), F.get(parts, F.lit(1))).alias("conversation_id"), error.alias("error"))


def snapshot_api_url(conversation_id: Column, host: str = SHARE_HOSTS[0]) -> Column:
    """Where a share's snapshot would be served; nothing is fetched here."""
    quoted = F.regexp_replace(F.url_encode(conversation_id), r"\+", "%20")
    quoted = F.regexp_replace(F.regexp_replace(quoted, "%7E", "~"), r"\*", "%2A")
    return F.concat(F.lit(f"https://{host}/api/chat_snapshots/"), quoted, F.lit("?rendering_mode=messages&render_all_tools=true"))
