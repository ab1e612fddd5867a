"""Keyword search by an inverted index of trigrams, so that a query reads the postings of its rarest trigrams and the blocks
of listings that hold what these leave, instead of all names.

An index is a folder of segments, one for each batch of listings that is added:
  listing/block=b     the shown columns, newest first, `block_rows` a block, i a row's place in its block
  postings/part=p     gram, block, i: the rows of each trigram of a name or clean name, A-Z folded, by range of gram and block
  grams/part=p        gram, n: how many postings of the trigram the part has
  parts               part, low, high: the trigrams at a part's ends
A trigram that a large share of rows has spreads over as many parts as its postings fill.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodex.functions import text
from lodex.operators import rank, search
from lodex.sources.shared import folders, stored

BLOCK_ROWS = 1 << 16
#: Trigrams of a query that are intersected at most, and how much more frequent than its rarest one they may be: a list that is
#: longer costs more than the rows that it would rule out.
DEPTH, FACTOR = 4, 8
#: Distinct trigrams of all queries up to which parts are looked up, and blocks up to which they are named in the scan; beyond,
#: most are needed anyway and all are read.
MOST_GRAMS, MOST_BLOCKS = 2_000, 5_000

LISTING = "info_hash string, name string, total_size long, file_count int, created_at long, clean_name string, i int, block long"


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text, by code points, A-Z folded; none for shorter or null texts."""

    def of(chars: Column) -> Column:
        return F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 2, F.lit(0))), lambda a, i: F.concat(a, F.get(chars, i + 1), F.get(chars, i + 2)))

    parted = F.array(F.split(text.ascii_lower(F.coalesce(c, F.lit(""))), ""))  # parted once
    return F.array_distinct(F.flatten(F.transform(parted, of)))


def add(listings: DataFrame, path: str, segment: int = 0, block_rows: int = BLOCK_ROWS) -> None:
    """Writes a segment of the index; one that is written again replaces itself. Listings are stored in order once, and their
    trigrams dealt by range once. A changed name needs its segment again."""
    spark, own = listings.sparkSession, f"{path}/segment={segment}"
    rows = listings.select("info_hash", "name", "total_size", "file_count", "created_at", "clean_name")
    placed = rank.numbered(rows, [F.desc("created_at"), F.col("info_hash")], block_rows, "block", "i")
    placed.write.mode("overwrite").partitionBy("block").parquet(f"{own}/listing")
    placed = spark.read.schema(LISTING).parquet(f"{own}/listing")
    grams = placed.select("block", "i", F.explode(F.array_union(trigrams(F.col("name")), trigrams(F.col("clean_name")))).alias("gram"))
    dealt = grams.repartitionByRange("gram", "block").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "gram", "block", "i")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{own}/postings")
    counts = _read(spark, own, "postings", "gram string, block long, i int, part int").groupBy("part", "gram").agg(F.count("*").alias("n"))
    counts.repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{own}/grams")
    counts = _read(spark, own, "grams", "gram string, n long, part int")
    counts.groupBy("part").agg(F.min("gram").alias("low"), F.max("gram").alias("high")).write.mode("overwrite").parquet(f"{own}/parts")


def _read(spark: SparkSession, segment: str, what: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{segment}/{what}")


def segments(spark: SparkSession, path: str) -> list[str]:
    return folders(spark, path, "segment=")


def listings(spark: SparkSession, path: str) -> DataFrame:
    """All listings of the index."""
    return reduce(DataFrame.unionByName, (_read(spark, s, "listing", LISTING) for s in segments(spark, path)))


def search_batch(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """What search.search_batch gives for the index's listings: query_id, total, place, info_hash, name.

    Queries with a keyword of three or more characters go by the index; those of shorter ones, or of none, scan the listings.
    Blocks of search.MOST_QUERIES queries are broadcast.
    """
    asked = search.page_parameters(queries)
    grams = F.array_distinct(F.flatten(F.transform("words", trigrams)))
    asked = stored(asked.withColumn("grams", grams), "asked")
    n = max(1, -(-asked.count() // search.MOST_QUERIES))
    out = search.search_batch(listings(spark, path), queries.join(asked.where("size(grams) = 0").select("query_id"), "query_id", "left_semi"))
    for k in range(n):
        own = asked.where((F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) & (F.size("grams") > 0))
        hits = reduce(DataFrame.unionByName, (_segment_hits(spark, s, own) for s in segments(spark, path)))
        out = out.unionByName(search.pages(stored(hits, "hits")))
    return out


def _segment_hits(spark: SparkSession, segment: str, asked: DataFrame) -> DataFrame:
    """query_id, page, page_size and the shown columns of a segment's matching rows."""
    met = candidates(spark, segment, asked)
    rows = _read(spark, segment, "listing", LISTING)
    blocks = [r.block for r in met.select("block").distinct().limit(MOST_BLOCKS + 1).collect()]
    if len(blocks) <= MOST_BLOCKS:  # folders of other blocks aren't opened
        rows = rows.where(F.col("block").isin(blocks)) if blocks else rows.where("false")
    low = rows.select("block", "i", "info_hash", search.display_name().alias("name"), "created_at", text.ascii_lower(F.col("name")).alias("_a"), text.ascii_lower(F.coalesce("clean_name", F.lit(""))).alias("_b"))
    found = low.join(met, ["block", "i"]).join(F.broadcast(asked.select("query_id", "words", "page", "page_size")), "query_id")
    exact = F.forall("words", lambda w: F.contains(F.col("_a"), w) | F.contains(F.col("_b"), w))
    return found.where(exact).select("query_id", "page", "page_size", "info_hash", "name", "created_at")


def candidates(spark: SparkSession, segment: str, asked: DataFrame) -> DataFrame:
    """query_id, block, i (stored): rows that have the rarest trigrams of a query, all of those that are intersected."""
    wanted = asked.select("query_id", F.explode("grams").alias("gram"))
    parts = _parts(spark, segment, wanted)
    counts = parts(_read(spark, segment, "grams", "gram string, n long, part int"))
    counts = counts.join(F.broadcast(wanted.select("gram").distinct()), "gram").groupBy("gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("query_id").orderBy("n", "gram")  # a query's trigrams are at most its bytes
    ranked = wanted.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumns({"place": F.row_number().over(by_count), "least": F.min("n").over(Window.partitionBy("query_id"))})
    chosen = ranked.where((F.col("place") <= DEPTH) & (F.col("n") <= FACTOR * F.col("least")) | (F.col("place") == 1))
    chosen = stored(chosen.withColumn("of", F.count("*").over(Window.partitionBy("query_id"))).select("query_id", "gram", "of"), "chosen")
    postings = parts(_read(spark, segment, "postings", "gram string, block long, i int, part int"))
    met = postings.join(F.broadcast(chosen), "gram")
    alone = met.where("of = 1").select("query_id", "block", "i")  # nothing to intersect, nothing to shuffle
    both = met.where("of > 1").groupBy("query_id", "block", "i").agg(F.count("*").alias("k"), F.max("of").alias("of")).where("k = of").select("query_id", "block", "i")
    return stored(alone.unionByName(both), "candidates")


def _parts(spark: SparkSession, segment: str, wanted: DataFrame):
    """A filter of a table by parts: those whose range holds a wanted trigram."""
    grams = [r.gram for r in wanted.select("gram").distinct().limit(MOST_GRAMS + 1).collect()]
    if len(grams) > MOST_GRAMS:
        return lambda df: df
    inside = F.exists(F.array(*map(F.lit, grams)).cast("array<string>"), lambda g: (g >= F.col("low")) & (g <= F.col("high")))
    found = [r.part for r in _read(spark, segment, "parts", "part int, low string, high string").where(inside).select("part").collect()]
    return lambda df: df.where(F.col("part").isin(found)) if found else df.where("false")
