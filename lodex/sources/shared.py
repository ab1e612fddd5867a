"""Tables and folders that driver and executors share, for what a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset and all runs in this process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    if not where:
        where = shared_dir.own = tempfile.mkdtemp(prefix="lodex-")
    return where.rstrip("/")


#: All that this process stores lies in one folder of the shared one, so that it can be told apart and cleared.
RUN = f"lodex-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in this run's folder."""
    return f"{shared_dir(spark)}/{RUN}/{what}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes this run's folder: all tables between steps. Results that still read them must have been written before."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{RUN}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The folders or files in a folder whose names begin so, in order of their names; none if there is no such folder."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    system = at.getFileSystem(conf)
    return sorted(str(s.getPath()) for s in system.listStatus(at) if s.getPath().getName().startswith(prefix)) if system.exists(at) else []
