"""Charts: the first titles of each, resolved names, and keeping the last good lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodex.functions import text


def first_n(items: DataFrame, n: int = 10) -> DataFrame:
    """chart, place, id, title: the n items of the largest weight of each chart, then by id."""
    order = Window.partitionBy("chart").orderBy(F.desc("weight"), "id")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("chart", "place", "id", "title")


def resolved(items: DataFrame, names: DataFrame) -> DataFrame:
    """Items with the original name of their id where one is known (names: id, full_title), else the chart's title."""
    known = names.select(F.col("id").alias("_id"), "full_title")
    found = F.nullif(text.original_name(F.col("full_title"), F.col("title")), F.lit(""))
    met = items.join(known, items["id"] == known["_id"], "left")
    return met.select(*items.columns, F.coalesce(found, F.col("title")).alias("shown"))


def unresolved(items: DataFrame, names: DataFrame) -> DataFrame:
    return items.select("id").distinct().join(names.select("id"), "id", "left_anti")


def keep_last(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """New lists, and the old list of each chart that the new table lacks (a failed or empty one); rows of new lists carry
    the new time, and the old lists theirs."""
    got = new.select("chart").distinct()
    return new.withColumn("updated_at", F.lit(now).cast("long")).unionByName(old.join(got, "chart", "left_anti"))


def lists(items: DataFrame, charts: list[str]) -> DataFrame:
    """chart and titles (array) of every named chart; one never fetched has an empty list. A chart has a bounded list."""
    own = items.groupBy("chart").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("titles"))
    named = items.sparkSession.createDataFrame([(c,) for c in charts], "chart string")
    return named.join(own, "chart", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
