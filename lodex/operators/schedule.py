"""When nodes are due again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.functions import keys


def merged_replies(replies: DataFrame) -> DataFrame:
    """Rows of the two node lists (arrays of addr, port) of a reply (ts, interval_s, nodes, nodes6)."""
    return replies.select("ts", "interval_s", F.explode(F.concat("nodes", "nodes6")).alias("n")).select("n.addr", "n.port", "ts", "interval_s")


def next_due(observations: DataFrame) -> DataFrame:
    """addr, last_seen, next_due (seconds): by the latest observation of each address; port 0 is skipped."""
    rows = observations.where("port <> 0")
    at = F.unix_timestamp("ts")
    last = rows.groupBy("addr").agg(F.max("ts").alias("ts"), F.max_by("interval_s", "ts").alias("interval_s"))
    return last.select("addr", at.alias("last_seen"), (at + keys.interval(F.col("interval_s"))).alias("next_due"))


def due(observations: DataFrame, now: int) -> DataFrame:
    return next_due(observations).where(F.col("next_due") <= now)
