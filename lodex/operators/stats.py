"""Counters, their differences, ratios and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodex.sources.shared import stored


def totals(deltas: DataFrame) -> DataFrame:
    """key, value: the sums of appended deltas."""
    return deltas.groupBy("key").agg(F.sum("delta").alias("value"))


def differences(readings: DataFrame) -> DataFrame:
    """name, ts, delta of running counters (name, ts, value): from the reading before (of equal times, in order of value),
    the first in full. Readings lie in ranges of name and time, and each range's first takes the last value before, so a
    counter of any number of readings is never in one task."""
    order = ["name", "ts", "value"]
    rows = stored(readings.select(*order).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "readings")
    within = F.lag("value").over(Window.partitionBy("name", "_part").orderBy("ts", "value"))
    ends = rows.groupBy("name", "_part").agg(F.max(F.struct("ts", "value"))["value"].alias("_last"))  # a row for each counter and range
    ends = ends.select(F.col("name").alias("_name"), F.col("_part").alias("_own"), F.lag("_last", 1, 0).over(Window.partitionBy("name").orderBy("_part")).alias("_before"))
    met = rows.withColumn("_lag", within).join(ends, F.col("name").eqNullSafe(F.col("_name")) & (F.col("_part") == F.col("_own")))
    return met.select("name", "ts", (F.col("value") - F.coalesce("_lag", "_before")).alias("delta"))


def report(counters: DataFrame, listings: DataFrame, blocked: DataFrame, names: list[str]) -> DataFrame:
    """One row: each named counter (0 where missing), and total, pending and blocked counts."""
    own = counters.agg(*(F.coalesce(F.sum(F.when(F.col("key") == n, F.col("value"))), F.lit(0)).alias(n) for n in names))
    counts = listings.agg(F.count("*").alias("total"), F.count_if(F.col("reviewed_at") == 0).alias("pending"))
    return own.crossJoin(counts).crossJoin(blocked.agg(F.count("*").alias("blocked")))  # one row each


def as_map(counters: DataFrame) -> DataFrame:
    """All counters in one map; there are as many as names."""
    return counters.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("stats"))


def shares(counters: DataFrame, parts: list[str], ratio: tuple[str, str]) -> DataFrame:
    """One row: each part's share of the parts' sum, and the ratio of two counters; null where the divisor is 0."""
    value = lambda n: F.coalesce(F.sum(F.when(F.col("key") == n, F.col("value"))), F.lit(0))
    total = sum((value(n) for n in parts[1:]), value(parts[0]))
    return counters.agg(*(F.try_divide(value(n), total).alias(f"{n}_share") for n in parts), F.try_divide(value(ratio[0]), value(ratio[1])).alias("yield"))
