"""Expressions for keys, addresses and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_key(c: Column) -> Column:
    """40 hexadecimal digits, not all zero."""
    return F.coalesce(c.rlike(r"\A[0-9a-fA-F]{40}\z") & ~c.rlike(r"\A0{40}\z"), F.lit(False))


def host_port(url: Column, scheme: str = "udp") -> Column:
    """host:port of a URL of that scheme with a host; else null."""
    return F.nullif(F.regexp_extract(url, r"(?i)\A" + scheme + r"://(?:[^/?#@]*@)?([^/?#@]+)", 1), F.lit(""))


def magnet(key: Column, name: Column, trackers: list[str] | None = None) -> Column:
    from lodex.functions.text import escaped_query

    tail = [F.concat(F.lit("&tr="), escaped_query(F.lit(t.strip()))) for t in trackers or () if t.strip()]
    return F.concat(F.lit("magnet:?xt=urn:btih:"), key, F.lit("&dn="), escaped_query(name), *tail)


def interval(seconds: Column) -> Column:
    """Seconds until a node is due: 15 minutes where not given, else from a minute to two hours."""
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, 900).otherwise(F.least(F.greatest(seconds, F.lit(60)), F.lit(7200))).cast("long")
