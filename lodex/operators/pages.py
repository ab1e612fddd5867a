"""Newest-first pages that read only the time range that holds them.

Beside the listings, written in order of time, lies a histogram: listings by interval of time. A page's offset is looked up in
its running sums, and the intervals that hold the page are the range that the scan is given. Keyset paging needs no
histogram: it goes on behind a page's last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodex.operators import search
from lodex.sources.tables import LISTING

#: Seconds of an interval.
WIDTH = 3600


def write(listings: DataFrame, path: str, width: int = WIDTH) -> None:
    """Writes the listings by time, newest first, and their histogram (slot, n). A listing without a time is the oldest."""
    spark = listings.sparkSession
    rows = listings.select(*LISTING).withColumn("created_at", F.coalesce("created_at", F.lit(0).cast("long")))
    rows.repartitionByRange(F.desc("created_at"), F.col("info_hash")).sortWithinPartitions(F.desc("created_at"), "info_hash").write.mode("overwrite").parquet(f"{path}/listing")
    slots = read(spark, path).groupBy(F.floor(F.col("created_at") / width).alias("slot")).agg(F.count("*").alias("n"))
    slots.coalesce(1).write.mode("overwrite").parquet(f"{path}/histogram")  # a row for each interval in use


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} {k}" for c, k in LISTING.items())).parquet(f"{path}/listing")


def span(spark: SparkSession, path: str, offset: int, size: int) -> tuple[int, int, int] | None:
    """First and last interval of the rows from `offset` on, newest first, and how many rows newer intervals have; none beyond
    the last row."""
    before = F.sum("n").over(Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    held = spark.read.schema("slot long, n long").parquet(f"{path}/histogram").withColumn("before", before)
    own = held.where((F.col("before") < offset + size) & (F.col("before") + F.col("n") > offset))
    low, high, newer = own.agg(F.min("slot"), F.max("slot"), F.min("before")).first()
    return None if low is None else (low, high, newer)


def page_number(page: int, size: int) -> tuple[int, int]:
    """Page and size within the limits of a search."""
    page, size = max(1, page), min(max(1, size), search.MOST_PAGE_SIZE)
    return (search.MOST_OFFSET // size + 1 if (page - 1) * size > search.MOST_OFFSET else page), size


def latest(spark: SparkSession, path: str, page: int = 1, size: int = search.PAGE_SIZE, width: int = WIDTH) -> DataFrame:
    """What search.latest gives. The scan's range of created_at holds the page's intervals only."""
    page, size = page_number(page, size)
    offset, rows, newer = (page - 1) * size, read(spark, path), 0
    held = span(spark, path, offset, size)
    if held:
        low, high, newer = held
        rows = rows.where((F.col("created_at") >= low * width) & (F.col("created_at") < (high + 1) * width))
    else:
        rows = rows.where("false")
    return search.results(rows).orderBy(F.desc("created_at"), "info_hash").offset(offset - newer).limit(size)


def behind(created_at: int, info_hash: str) -> Column:
    """Rows that come after this one, newest first, then by key."""
    at = F.col("created_at")
    return (at <= created_at) & ((at < created_at) | (F.col("info_hash") > info_hash))


def search_after(listings: DataFrame, q: str, last: tuple[int, str] | None = None, size: int = search.PAGE_SIZE) -> DataFrame:
    """The next `size` matches behind the last row of a page (created_at, info_hash), or the first ones: as deep as wanted, at
    the cost of a first page. The bound on the time reaches the scan."""
    rows = listings if last is None else listings.where(behind(*last))
    return search.results(rows.where(search.matches(search.query_words(q)))).orderBy(F.desc("created_at"), "info_hash").limit(min(max(1, size), search.MOST_PAGE_SIZE))
