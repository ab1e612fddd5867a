"""Ranking discovered keys by reported popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodex.functions import keys
from lodex.sources.shared import stored

CAPACITY, BATCH = 1 << 14, 70


def valid_keys(rows: DataFrame, key: str = "info_hash") -> DataFrame:
    return rows.where(keys.valid_key(F.col(key)))


def tracker_hosts(urls: DataFrame, scheme: str = "udp", url: str = "url") -> DataFrame:
    """host:port of the URLs of that scheme with a host; others are skipped. No such URL at all fails the job that reads
    hosts (see some_host())."""
    return urls.select(*[c for c in urls.columns if c != url], keys.host_port(F.col(url), scheme).alias("host")).where("host is not null")


def some_host(hosts: DataFrame) -> DataFrame:
    """The hosts; an empty table of them is an error."""
    if hosts.isEmpty():
        raise ValueError("no tracker URL of that scheme has a host")
    return hosts


def best_seeders(given: DataFrame, replies: DataFrame, key: str = "hash") -> DataFrame:
    """key, seeders: the most that any tracker reports, 0 where none does; failed replies (null) count for nothing."""
    best = replies.groupBy(key).agg(F.greatest(F.lit(0), F.max("seeders")).alias("best"))
    return given.select(key).distinct().join(best, key, "left").select(key, F.coalesce("best", F.lit(0)).alias("seeders"))


def rank_counters(ranked: DataFrame, replies: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """scraped, seeded, evicted (what a queue of this capacity can't hold of them) and errors, one row."""
    evicted = F.greatest(F.lit(0).cast("long"), F.count("*") - capacity).alias("evicted")
    return ranked.agg(F.count("*").alias("scraped"), F.count_if(F.col("seeders") > 0).alias("seeded"), evicted).crossJoin(replies.agg(F.count_if(F.col("seeders").isNull()).alias("errors")))


def aligned(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Each requested key with the number at its place in the answer. requests: batch_id, hashes (array); answers: batch_id,
    seeders (array). A short answer leaves 0, a long one is cut."""
    asked = requests.select("batch_id", F.posexplode("hashes").alias("pos", "hash"))
    given = answers.select("batch_id", F.posexplode("seeders").alias("pos", "seeders"))
    return asked.join(given, ["batch_id", "pos"], "left").select("batch_id", "pos", "hash", F.coalesce("seeders", F.lit(0)).alias("seeders"))


def queue(pending: DataFrame, new: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The best `capacity` items (hash, seeders, seq) of the queue and a new batch: most seeders first, then by arrival."""
    rows = pending if new is None else pending.unionByName(new)
    return rows.orderBy(F.desc("seeders"), "seq").limit(capacity)


def evicted(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What falls off the capacity: all items but those of queue()."""
    return rows.join(queue(rows, None, capacity).select("hash", "seq"), ["hash", "seq"], "left_anti")


def numbered(rows: DataFrame, order: list[Column], size: int, batch: str = "batch", place: str = "i") -> DataFrame:
    """Adds the number of the row's batch of `size` (from 0) and its place there (from 1), in the given order.

    The rows are range-partitioned, sorted and stored with their place in the partition, and numbered with the partitions'
    counts before them: no task sees more than its own partition.
    """
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a partition
    numbers = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_row", F.col("_before") + own)
    return numbers.withColumn(batch, F.floor(F.col("_row") / size)).withColumn(place, (F.col("_row") % size + 1).cast("int")).select(*rows.columns, batch, place)


def numbered_by(rows: DataFrame, by: str, order: list, size: int) -> DataFrame:
    """Batches within each value of `by`."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size)).withColumn("i", (n % size + 1).cast("int"))
