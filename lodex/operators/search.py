"""Keyword search, newest first, for one query or a table of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodex.functions import keys, text

#: Limits of a query: bytes, page size, rows that paging may skip.
QUERY_BYTES, PAGE_SIZE, MOST_PAGE_SIZE, MOST_OFFSET = 200, 20, 100, 10_000
#: Queries that one pass may broadcast.
MOST_QUERIES = 10_000


def display_name() -> Column:
    return F.when(F.col("clean_name") != "", F.col("clean_name")).otherwise(F.col("name"))


def matches(words: list[str]) -> Column:
    """Every keyword occurs in the name or in the clean name; letters A-Z match either case, wildcards are literal."""
    hit = F.lit(True)
    for w in words:
        hit = hit & (F.contains(text.ascii_lower(F.col("name")), F.lit(w)) | F.contains(text.ascii_lower(F.col("clean_name")), F.lit(w)))
    return hit


def query_words(q: str) -> list[str]:
    """The keywords of a query, as text.keywords() of its first QUERY_BYTES bytes gives them."""
    whole = q.encode("utf-8", "surrogatepass")[:QUERY_BYTES].decode("utf-8", "ignore")
    return [w for w in re.split(text.WHITE_CLASS, "".join(c.lower() if c.isascii() else c for c in whole)) if w][:8]


def results(rows: DataFrame) -> DataFrame:
    return rows.select("info_hash", display_name().alias("name"), "total_size", "file_count", "created_at")


def search(listings: DataFrame, q: str, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page of the listings that match, newest first, then by key. A blank query matches all. The order's columns and
    the shown ones are all that is read; the page comes from a top-k of each partition."""
    page, size = max(1, page), min(max(1, size), MOST_PAGE_SIZE)
    page = MOST_OFFSET // size + 1 if (page - 1) * size > MOST_OFFSET else page
    rows = results(listings.where(matches(query_words(q)))).orderBy(F.desc("created_at"), "info_hash")
    return rows.offset((page - 1) * size).limit(size)


def latest(listings: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    return search(listings, "", page, size)


def totals(listings: DataFrame, blocked: DataFrame, q: str) -> DataFrame:
    """One row: matching, all and unreviewed listings, and blocked keys."""
    counts = listings.agg(F.count_if(matches(query_words(q))).alias("matched"), F.count("*").alias("total"), F.count_if(F.col("reviewed_at") == 0).alias("pending"))
    return counts.crossJoin(blocked.agg(F.count("*").alias("blocked")))  # one row each


def page_parameters(queries: DataFrame) -> DataFrame:
    """query_id, words, page and page_size of queries given as text: what can't be read is the default."""
    number = lambda c, d: F.coalesce(F.expr(f"try_cast({c} AS bigint)"), F.lit(d))
    size = F.when(number("page_size", PAGE_SIZE) < 1, PAGE_SIZE).otherwise(F.least(number("page_size", PAGE_SIZE), F.lit(MOST_PAGE_SIZE)))
    page = F.greatest(number("page", 1), F.lit(1))
    rows = queries.select("query_id", text.keywords(text.byte_prefix(F.col("q"), QUERY_BYTES)).alias("words"), page.alias("page"), size.cast("long").alias("page_size"))
    deep = (F.col("page") - 1) * F.col("page_size") > MOST_OFFSET
    return rows.withColumn("page", F.when(deep, F.floor(F.lit(MOST_OFFSET) / F.col("page_size")) + 1).otherwise(F.col("page")).cast("long"))


def search_batch(listings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, total, place, info_hash, name of the page that each query asks for.

    The queries are broadcast if there are at most MOST_QUERIES, else they go in blocks of that many; a listing row meets
    the queries in its own task, and only pages' candidates (a top-k by query in every task) are shuffled.
    """
    asked = page_parameters(queries)
    n = max(1, -(-asked.count() // MOST_QUERIES))
    out = None
    for k in range(n):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)
        low = listings.select("info_hash", display_name().alias("name"), "created_at", text.ascii_lower(F.col("name")).alias("_a"), text.ascii_lower(F.col("clean_name")).alias("_b"))
        hit = low.join(F.broadcast(own), F.forall("words", lambda w: F.contains(F.col("_a"), w) | F.contains(F.col("_b"), w))).drop("_a", "_b", "words")
        page = pages(hit)
        out = page if out is None else out.unionByName(page)
    return out


def pages(hit: DataFrame) -> DataFrame:
    """query_id, total, place, info_hash, name of the pages of all hits (query_id, page, page_size, info_hash, name, created_at):
    newest first, then by key."""
    total = hit.groupBy("query_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("query_id").orderBy(F.desc("created_at"), "info_hash")
    placed = hit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_OFFSET + MOST_PAGE_SIZE)
    page = placed.where((F.col("place") > (F.col("page") - 1) * F.col("page_size")) & (F.col("place") <= F.col("page") * F.col("page_size")))
    return page.join(F.broadcast(total), "query_id").select("query_id", "total", "place", "info_hash", "name")


def links(listings: DataFrame, trackers: list[str] | None = None) -> DataFrame:
    return listings.select("info_hash", keys.magnet(F.col("info_hash"), display_name(), trackers).alias("link"))


def file_rollup(listings: DataFrame, shown: int = 10) -> DataFrame:
    """info_hash, the files' common directory, the number of files not shown, and pages of the shown number of files."""
    n = F.size("files")
    return listings.select(
        "info_hash",
        text.common_dir(F.col("files.path")).alias("common_dir"),
        (F.greatest("file_count", n) - F.least(F.lit(shown), n)).cast("long").alias("hidden"),
        F.greatest(F.lit(1), F.ceil(F.col("file_count") / shown)).cast("long").alias("pages"),
    )


def as_json(rows: DataFrame) -> DataFrame:
    """The rows as JSON records."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("record"))
