"""Second review in batches: requests, verdicts by ordinal, and applying them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.functions import text
from lodex.operators import merge, rank

BATCH, BATCHES = 100, 20
LABELS = ("adult", "spam")
VERDICTS = "array<struct<i:int,label:string,clean:string>>"


def candidates(listings: DataFrame, limit: int | None = None) -> DataFrame:
    """Unreviewed listings, oldest first; the file list isn't read."""
    rows = listings.where("reviewed_at = 0").select("info_hash", "name", "total_size", "file_count", "created_at")
    return rows if limit is None else rows.orderBy("created_at", "info_hash").limit(limit)


def batched(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """Candidates with batch_id (from 0) and i (from 1), oldest first."""
    return rank.numbered(rows, [F.col("created_at"), F.col("info_hash")], size, "batch_id", "i")


def prompt_title(name: Column) -> Column:
    line = text.one_line(name)
    return F.when(F.length(line) > 200, F.concat(F.left(line, F.lit(200)), F.lit("…"))).otherwise(line)


def requests(rows: DataFrame) -> DataFrame:
    """batch_id and content: a batch's items as a JSON list in order. A batch has a fixed number of rows."""
    item = F.struct("i", prompt_title(F.col("name")).alias("title"), text.size_label(F.col("total_size")).alias("size"), F.col("file_count").alias("files"))
    return rows.groupBy("batch_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("content"))


def verdicts(replies: DataFrame) -> DataFrame:
    """batch_id, i, label and clean by ordinal, from replies (batch_id, content), which may be fenced JSON.

    Only the labels of LABELS count, the last such one of an ordinal; the last clean title wins. A reply that can't be
    read gives no rows, so its batch isn't answered.
    """
    parsed = replies.select("batch_id", F.from_json(text.unfenced(F.col("content")), VERDICTS).alias("v")).where("v is not null")
    rows = parsed.select("batch_id", F.posexplode("v").alias("pos", "v")).select("batch_id", "pos", F.col("v.i").alias("i"), F.lower(F.trim("v.label")).alias("label"), F.coalesce("v.clean", F.lit("")).alias("clean"))
    reject = F.col("label").isin(*LABELS)
    return rows.groupBy("batch_id", "i").agg(F.max_by(F.when(reject, F.col("label")), F.when(reject, F.col("pos"))).alias("label"), F.max_by("clean", "pos").alias("clean"))


def judged(rows: DataFrame, answered: DataFrame, replies: DataFrame) -> DataFrame:
    """Batched candidates of the answered batches before the first without a readable reply, where a run stops, with label
    ('ok' where none is given) and clean ('' where none is accepted)."""
    done = replies.where(F.from_json(text.unfenced(F.col("content")), VERDICTS).isNotNull()).select("batch_id").distinct()
    failed = rows.select("batch_id").distinct().join(done, "batch_id", "left_anti").agg(F.min("batch_id").alias("_failed"))  # one row
    met = rows.join(F.broadcast(failed), F.col("_failed").isNull() | (F.col("batch_id") < F.col("_failed"))).drop("_failed")
    met = met.join(answered, ["batch_id", "i"], "left")
    return met.withColumn("label", F.coalesce("label", F.lit("ok"))).withColumn("clean", F.when(F.col("label") == "ok", text.accepted_title(F.col("name"), F.coalesce("clean", F.lit("")))).otherwise(""))


@dataclass
class Applied:
    listings: DataFrame
    blocked: DataFrame
    summary: DataFrame
    audit: DataFrame


def summary(rows: DataFrame) -> DataFrame:
    """One row: reviewed, by label, trimmed."""
    return rows.agg(F.count("*").alias("reviewed"), *(F.count_if(F.col("label") == k).alias(k) for k in LABELS), F.count_if(F.col("clean") != "").alias("trimmed"))


def audit(rows: DataFrame, dry_run: bool = False) -> DataFrame:
    """kind (trim or the reject's label), info_hash, title, clean and dry_run of everything a review changes."""
    kind = F.when(F.col("label") != "ok", F.col("label")).when(F.col("clean") != "", "trim")
    return rows.withColumn("kind", kind).where("kind is not null").select("kind", "info_hash", F.col("name").alias("title"), "clean", F.lit(dry_run).alias("dry_run"))


def append_audit(rows: DataFrame, path: str, run: int) -> None:
    """Adds a run's audit rows to the audit table; a run that is done again replaces its own rows."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """All runs' audit rows, with run."""
    return spark.read.schema("kind string, info_hash string, title string, clean string, dry_run boolean, run long").parquet(path)


def apply(listings: DataFrame, blocked: DataFrame, rows: DataFrame, now: int, dry_run: bool = False) -> Applied:
    """Applies judged rows: trims, rejects to the block-list, stamps. A dry run only stamps."""
    out, grown = listings, blocked
    if not dry_run:
        out = merge.set_clean_names(out, rows.where("clean <> ''").select("info_hash", "clean"))
        rejects = rows.where("label <> 'ok'").select("info_hash", F.col("label").alias("reason"), "name")
        out, grown, _ = merge.block(out, blocked, rejects, now)
    out = merge.mark_reviewed(out, rows, now)
    return Applied(out, grown, summary(rows), audit(rows, dry_run))


def sweep(listings: DataFrame, limit: int = BATCH * BATCHES, size: int = BATCH) -> DataFrame:
    """The candidates of one run, in batches: at most `limit`, or all for 0."""
    return batched(candidates(listings, limit or None), size)
