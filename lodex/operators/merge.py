"""Keeping the listing table: idempotent insert, block-list, reviews, trimmed names, increments and snapshots.

Plain Parquet has no row updates: each job computes the new table, and the caller writes it as a new version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodex.sources.tables import LISTING, upgraded

DELTA = [c for c in LISTING if c not in ("reviewed_at", "clean_name")]


def first_of_key(rows: DataFrame, order: list, key: str = "info_hash") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select("info_hash"), "info_hash", "left_anti")


def fresh(rows: DataFrame, target: DataFrame, blocked: DataFrame, order: list) -> DataFrame:
    """Rows to insert: the first of each key, if it is neither in the target nor blocked. All three steps share the
    exchange on the key."""
    first = first_of_key(rows, order)
    return first.join(target.select("info_hash"), "info_hash", "left_anti").join(blocked.select("info_hash"), "info_hash", "left_anti")


def insert_ignore(target: DataFrame, rows: DataFrame, blocked: DataFrame, order: list | None = None) -> DataFrame:
    new = fresh(rows, target, blocked, order or ["created_at"])
    return target.unionByName(new.select(*target.columns))


def not_in(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows whose key is NOT IN the block-list, as SQL has it: one null there rejects every row. The null test is one
    row; the rest is a plain anti-join, which takes any size."""
    nulls = blocked.where("info_hash IS NULL").limit(1).select(F.lit(1).alias("_null"))
    kept = rows.join(blocked.where("info_hash IS NOT NULL").select("info_hash"), "info_hash", "left_anti")
    none = blocked.limit(1).select(F.lit(1).alias("_any"))
    kept = kept.join(F.broadcast(nulls), F.lit(True), "left_anti")
    no_key = F.col("info_hash").isNotNull()
    return kept.where(no_key).unionByName(kept.where(~no_key).join(F.broadcast(none), F.lit(True), "left_anti"))


def delta(listings: DataFrame, mark: int, inclusive: bool = False) -> DataFrame:
    """The columns of a sync of rows after the mark; `inclusive` takes those at the mark again, which a merge ignores."""
    at = F.col("created_at")
    return listings.where(at >= mark if inclusive else at > mark).select(*DELTA)


def delta_mark(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("created_at").alias("mark"), F.count("*").alias("n"))


def sync(target: DataFrame, rows: DataFrame, blocked: DataFrame, null_aware: bool = False) -> DataFrame:
    """The target with a delta merged in; merged rows start unreviewed and untrimmed."""
    given = upgraded(rows)
    given = not_in(given, blocked) if null_aware else given
    return insert_ignore(target, given, blocked)


def block(listings: DataFrame, blocked: DataFrame, rejects: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings without the rejected keys (info_hash, reason, name), the grown block-list (a known key keeps its reason), and
    one row with how many listings really went."""
    gone = first_of_key(rejects, ["reason", "name"])
    left = listings.join(gone.select("info_hash"), "info_hash", "left_anti")
    new = gone.join(blocked.select("info_hash"), "info_hash", "left_anti").select("info_hash", "reason", "name", F.lit(now).cast("long").alias("created_at"))
    removed = listings.join(gone.select("info_hash"), "info_hash", "left_semi").agg(F.count("*").alias("removed"))
    return left, blocked.unionByName(new), removed


def paired(spark: SparkSession, hashes: list[str], names: list[str], reason: str) -> DataFrame:
    """Reject rows from two lists of equal length."""
    if len(hashes) != len(names):
        raise ValueError("as many names as keys are needed")
    return spark.createDataFrame([(h, reason, n) for h, n in zip(hashes, names, strict=True)], "info_hash string, reason string, name string")


def mark_reviewed(listings: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    hit = keys.select("info_hash", F.lit(True).alias("_hit")).distinct()
    return listings.join(hit, "info_hash", "left").withColumn("reviewed_at", F.when(F.col("_hit"), F.lit(now).cast("long")).otherwise(F.col("reviewed_at"))).drop("_hit").select(*listings.columns)


def set_clean_names(listings: DataFrame, trims: DataFrame) -> DataFrame:
    """Listings with the clean names of `trims` (info_hash, clean); raw names stay."""
    given = first_of_key(trims, ["clean"]).select("info_hash", F.col("clean").alias("_clean"))
    return listings.join(given, "info_hash", "left").withColumn("clean_name", F.coalesce("_clean", "clean_name")).drop("_clean").select(*listings.columns)


def fingerprint(rows: DataFrame) -> DataFrame:
    """Row count and order-free hashes of all columns: the exclusive or, and the sum, which minds equal rows."""
    return rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("hash"), F.sum(F.xxhash64(*rows.columns, F.lit(1)).cast("decimal(38,0)")).alias("sum"))


def snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Writes the table as zstd Parquet to a new folder in `path`, reads it back, compares counts and hashes, and only then
    makes it the current one by renaming a pointer file over the last: a reader finds the old snapshot or the new one,
    whenever the job stops. Returns the fingerprint with verified = true; a difference fails the job and publishes
    nothing. Older folders are left for the caller to clear."""
    spark, name = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("created_at").write.option("compression", "zstd").parquet(f"{path}/{name}")
    copy = fingerprint(spark.read.schema(rows.schema).parquet(f"{path}/{name}")).withColumn("verified", F.lit(True))
    if fingerprint(rows).first() != copy.drop("verified").first():
        raise ValueError("the snapshot differs from the table")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    draft, current = hadoop.Path(f"{path}/{name}.txt"), hadoop.Path(f"{path}/current.txt")
    out = draft.getFileSystem(conf).create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf).rename(draft, current, how)
    return copy


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current snapshot."""
    name = spark.read.option("wholetext", True).text(f"{path}/current.txt").first()[0]
    return spark.read.schema(schema).parquet(f"{path}/{name}")
