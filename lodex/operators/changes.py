"""Reviews as one table of changes, of which listings, block-list and audit log are folds.

A store is a folder of runs and bases:
  run=n    the changes of review run n: kind (trim, reject or stamp), info_hash, title, value, at, dry_run
  base=n   listing, audit and blocked as they are after run n, in this order
A run's folder counts once its _SUCCESS file is there, a base once all its tables are: whatever job is stopped wherever, a reader
finds all of a run in all three tables or nothing of it in any. Runs are numbered from 1 and may be done again; a
run reads the tables as they were before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.operators import merge, review
from lodex.sources.shared import folders, stored
from lodex.sources.tables import LISTING

CHANGE = "kind string, info_hash string, title string, value string, at long, dry_run boolean"
TABLES = {"listing": ", ".join(f"{c} {k}" for c, k in LISTING.items()), "audit": "kind string, info_hash string, title string, clean string, dry_run boolean, run long", "blocked": "info_hash string, reason string, name string, created_at long"}


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _number(folder: str) -> int:
    return int(folder.rpartition("=")[2])


def _base(spark: SparkSession, path: str, before: int | None) -> int:
    """The newest base that is whole."""
    found = [f for f in folders(spark, path, "base=") if before is None or _number(f) < before]
    whole = [_number(f) for f in found if all(folders(spark, f"{f}/{t}", "_SUCCESS") for t in TABLES)]
    if not whole:
        raise ValueError(f"no table of listings in {path}")
    return max(whole)


def _since(spark: SparkSession, path: str, base: int, before: int | None) -> DataFrame:
    """The changes of whole runs after the base, with run."""
    runs = [f for f in folders(spark, path, "run=") if base < _number(f) and (before is None or _number(f) < before) and folders(spark, f, "_SUCCESS")]
    each = [spark.read.schema(CHANGE).parquet(f).withColumn("run", F.lit(_number(f)).cast("long")) for f in runs]
    return reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], f"{CHANGE}, run long")


def _held(spark: SparkSession, path: str, table: str, base: int) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{path}/base={base}/{table}")


def start(listings: DataFrame, blocked: DataFrame, path: str) -> None:
    """Makes a store of tables as they are."""
    _write(listings.select(*LISTING), f"{path}/base=0/listing")
    _write(listings.sparkSession.createDataFrame([], TABLES["audit"]), f"{path}/base=0/audit")
    _write(blocked.select("info_hash", "reason", "name", F.col("created_at").cast("long").alias("created_at")), f"{path}/base=0/blocked")


def listings(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The base's listings with each key's last trim and stamp, without the rejected ones. Changes meet in one row a key and
    share its exchange with the listings."""
    base = _base(spark, path, before)
    real = lambda kind: (F.col("kind") == kind) & (~F.col("dry_run") | (F.col("kind") == "stamp"))
    last = lambda kind, c: F.max_by(F.when(real(kind), F.col(c)), F.when(real(kind), F.col("run")))
    own = _since(spark, path, base, before).groupBy("info_hash").agg(last("trim", "value").alias("_clean"), last("stamp", "at").alias("_at"), F.bool_or(real("reject")).alias("_gone"))
    met = _held(spark, path, "listing", base).join(own, "info_hash", "left").where("not coalesce(_gone, false)")
    return met.withColumns({"clean_name": F.coalesce("_clean", "clean_name"), "reviewed_at": F.coalesce("_at", "reviewed_at")}).select(*LISTING)


def blocked(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The base's block-list and the keys rejected since, each with its first reason."""
    base = _base(spark, path, before)
    held = _held(spark, path, "blocked", base)
    first = lambda c: F.min_by(c, F.struct("run", "value", "title"))
    new = _since(spark, path, base, before).where("kind = 'reject' and not dry_run").groupBy("info_hash").agg(first("value").alias("reason"), first("title").alias("name"), first("at").alias("created_at"))
    return held.unionByName(merge.without(new, held))


def audit(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """kind (trim or the reject's label), info_hash, title, clean, dry_run and run of all that reviews changed or, in dry runs,
    would have."""
    base = _base(spark, path, before)
    new = _since(spark, path, base, before).where("kind <> 'stamp'")
    trim = F.col("kind") == "trim"
    told = new.select(F.when(trim, "trim").otherwise(F.col("value")).alias("kind"), "info_hash", "title", F.when(trim, F.col("value")).otherwise("").alias("clean"), "dry_run", "run")
    return _held(spark, path, "audit", base).unionByName(told)


def changes_of(rows: DataFrame, now: int, dry_run: bool = False) -> DataFrame:
    """The changes of judged rows: a stamp each, a trim where there is a clean title, a reject where the label isn't ok."""
    change = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    own = F.array_compact(F.array(change("stamp", F.lit("")), F.when(F.col("clean") != "", change("trim", F.col("clean"))), F.when(F.col("label") != "ok", change("reject", F.col("label")))))
    return rows.select(F.explode(own).alias("x"), "info_hash", F.col("name").alias("title")).select("x.kind", "info_hash", "title", "x.value", F.lit(now).cast("long").alias("at"), F.lit(dry_run).alias("dry_run"))


def review_run(spark: SparkSession, path: str, replies: DataFrame, run: int, now: int, limit: int = review.BATCH * review.BATCHES, dry_run: bool = False) -> None:
    """One sweep over what is unreviewed before the run: judged batch by batch up to the first without a readable reply, and
    written as the run's changes, in one folder."""
    if run < 1:
        raise ValueError("runs are numbered from 1")
    rows = review.judged(review.sweep(listings(spark, path, run), limit), review.verdicts(replies), replies)
    _write(changes_of(rows, now, dry_run), f"{path}/run={run}")


def compact(spark: SparkSession, path: str) -> int:
    """Makes a base of all whole runs; returns its number. Runs and bases before it may be cleared once it is whole."""
    whole = [_number(f) for f in folders(spark, path, "run=") if folders(spark, f, "_SUCCESS")]
    n = max(whole, default=0)
    if n > _base(spark, path, None):
        for table, rows in (("listing", listings(spark, path)), ("audit", audit(spark, path)), ("blocked", blocked(spark, path))):
            _write(stored(rows, table), f"{path}/base={n}/{table}")
    return n
