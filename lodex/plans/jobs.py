"""Whole jobs: from discovered keys to ranked ones, an incremental sync with its mark, and a review sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodex.operators import merge, rank, review
from lodex.sources.shared import stored
from lodex.sources.tables import LISTING


def rank_discovered(discovered: DataFrame, replies: DataFrame, capacity: int = rank.CAPACITY) -> DataFrame:
    """The best `capacity` valid keys (hash, seeders, seq), each once: by the most seeders any tracker reports, then by arrival."""
    first = merge.first_of_key(rank.valid_keys(discovered, "hash"), ["seq"], "hash")
    best = rank.best_seeders(first, replies)
    return rank.queue(first.join(best, "hash").select("hash", "seeders", "seq"), None, capacity)


def read_mark(spark: SparkSession, path: str) -> int:
    """The last sync's mark; 0 before the first."""
    try:
        return spark.read.schema("mark long").parquet(path).agg({"mark": "max"}).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def sync_once(spark: SparkSession, source: DataFrame, target_path: str, version: int, blocked: DataFrame, mark_path: str, inclusive: bool = False) -> int:
    """Merges what is new in `source` into version `version` of the target, written as the next version; the mark is
    written last, so a failed merge is done again. Nothing new writes nothing. Returns the version to read."""
    new = merge.delta(source, read_mark(spark, mark_path), inclusive)
    seen = merge.delta_mark(new).first()
    if not seen.n:
        return version
    target = spark.read.schema(", ".join(f"{c} {k}" for c, k in LISTING.items())).parquet(f"{target_path}/v={version}")
    merge.sync(target, new, blocked).write.mode("overwrite").parquet(f"{target_path}/v={version + 1}")
    spark.createDataFrame([(seen.mark,)], "mark long").write.mode("overwrite").parquet(mark_path)
    return version + 1


def review_once(listings: DataFrame, blocked: DataFrame, replies: DataFrame, now: int, limit: int = review.BATCH * review.BATCHES, dry_run: bool = False) -> review.Applied:
    """One sweep: candidates are judged and applied batch by batch up to the first without a readable reply; it and later
    ones stay unreviewed and come again."""
    rows = stored(review.judged(review.sweep(listings, limit), review.verdicts(replies), replies), "judged")  # read for each change
    return review.apply(listings, blocked, rows, now, dry_run)
