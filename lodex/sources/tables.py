"""Schemas, readers that fill columns older data lack, and the listing views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "array<struct<path:string,size:bigint>>"
LISTING = {"info_hash": "string", "name": "string", "total_size": "bigint", "file_count": "int", "files": FILES, "created_at": "bigint", "reviewed_at": "bigint", "clean_name": "string"}
#: What a column is in data from before it was there.
DEFAULTS = {"reviewed_at": 0, "clean_name": ""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def upgraded(df: DataFrame) -> DataFrame:
    """A listing table of any version in today's schema: files_json becomes files (empty text is no files, bad JSON fails the
    job), and missing or null newer columns get their defaults."""
    if "files_json" in df.columns:
        text = F.when(F.coalesce("files_json", F.lit("")) == "", "[]").otherwise(F.col("files_json"))
        df = df.withColumn("files", F.from_json(text, FILES, {"mode": "FAILFAST"})).drop("files_json")
    for c, value in DEFAULTS.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in df.columns else F.lit(value))
    return df.select(*(F.col(c).cast(kind).alias(c) for c, kind in LISTING.items()))


def term_list(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """The terms of a text file or folder, one a line, without blanks around them, each once and in order. They become
    an automaton that tasks hold, so more than `most` are an error."""
    line = F.trim(F.regexp_replace("value", r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")).alias("term")
    return terms_of(spark.read.text(path).select(line), most)


def terms_of(rows: DataFrame, most: int = 100_000) -> tuple[str, ...]:
    """The same from a table with a column `term`."""
    got = rows.select("term").where("term is not null and term <> ''").distinct().orderBy("term").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(r.term for r in got)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """label, info_hash, title of the lines `<label> <40 hex digits> "<title>"`; other lines are skipped."""
    return parsed_journal(spark.read.text(path))


def parsed_journal(lines: DataFrame) -> DataFrame:
    at = r'\A.*?(\S+) ([0-9a-fA-F]{40}) "(.*)"\s*\z'
    part = lambda i: F.regexp_extract("value", at, i)
    return lines.where(F.col("value").rlike(at)).select(part(1).alias("label"), part(2).alias("info_hash"), part(3).alias("title"))


def kept_files(df: DataFrame, most: int = 50) -> DataFrame:
    """The first files only, and the true number of files."""
    return df.withColumn("file_count", F.size("files")).withColumn("files", F.slice("files", 1, most))


# Views over the given tables.


def key_of(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n + 1)), 40, "0")


def _files(paths: Column) -> Column:
    return F.transform(paths, lambda p: F.struct(p.alias("path"), F.length(p).cast("long").alias("size")))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    reviewed = labels.select("doc_id", F.lit(1).cast("long").alias("reviewed_at")).distinct()
    rows = records(docs.join(reviewed, "doc_id", "left"), "reviewed_at")
    return rows.withColumns({"reviewed_at": F.coalesce("reviewed_at", F.lit(0).cast("long")), "clean_name": F.lit("")})


def records(docs: DataFrame, *kept: str) -> DataFrame:
    """Documents as fetched records: the first line is the name, all lines are files."""
    lines = F.split("text", "\n", -1)
    return docs.select(
        key_of(F.col("doc_id")).alias("info_hash"),
        F.element_at(lines, 1).alias("name"),
        (F.col("n_chars") * 65536).alias("total_size"),
        F.size(lines).alias("file_count"),
        _files(lines).alias("files"),
        (F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
        *kept,
    )


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing, its files the words of the text."""
    found = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select(key_of(F.col("doc_id")).alias("info_hash"), _files(found).alias("files"))


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select(key_of(F.col("doc_id")).alias("info_hash"), F.lit("toxic").alias("reason"), F.lit("").alias("name"), F.lit(1704067200).cast("long").alias("created_at"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("tracker"), F.col("l_quantity").cast("int").alias("seeders"), F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("pos"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def node_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("addr"), F.when(F.col("event_type") == "error", 0).otherwise(6881).alias("port"), "ts", (F.get_json_object("props", "$.k").cast("long") * 120).alias("interval_s"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("chart"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("weight"))
