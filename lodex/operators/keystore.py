"""Keys in buckets with Bloom filters, so that a batch of keys is compared with what the store holds at the cost of the batch.

A store is a folder of batches, each of them written whole or not at all:
  batch=n/keys/bucket=b   the keys that batch n added, by a hash
  batch=n/filters         bucket, n, bits: a Bloom filter of each of these buckets; its _SUCCESS file makes the batch count
  base=n/...              the same for all batches up to n, made by compact()
A batch that is written again replaces itself. A key that no filter of its bucket knows is new, without a look at any key; the
buckets of the others are read, no others, and an exact join decides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.operators import merge
from lodex.sources.shared import folders, stored

#: Buckets of a store, filter bits of a key and places that a key sets: about one new key in a hundred reads its bucket in vain.
BUCKETS, BITS, PLACES = 256, 10, 7


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """The distinct keys that aren't null with hash and bucket."""
    h = F.xxhash64("info_hash")
    return keys.select("info_hash").where("info_hash is not null").distinct().select("info_hash", h.alias("h"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(buckets)).cast("int").alias("bucket"))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each hash sets, a row for each."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + np.arange(PLACES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)


def _filter(rows: pa.Table) -> pa.Table:
    h = rows["h"].to_numpy()
    bits = max(64, -(-len(h) * BITS // 8) * 8)
    held = np.zeros(bits, np.uint8)
    held[_places(h, bits).ravel()] = 1
    return pa.table({"bucket": rows["bucket"].slice(0, 1).cast(pa.int32()), "n": pa.array([len(h)], pa.int64()), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})


def _maybe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys that a filter of their bucket may hold."""
    h = keys["h"].to_numpy()
    hit = np.zeros(len(h), bool)
    for data in filters["bits"].to_pylist():
        held = np.unpackbits(np.frombuffer(data, np.uint8))
        hit |= held[_places(h, len(held))].all(axis=1)
    return keys.select(["info_hash", "bucket"]).filter(pa.array(hit))


def add(keys: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Adds keys (info_hash) as a batch. The store keeps its number of buckets; null keys are left out."""
    _write(_hashed(keys, buckets), f"{path}/batch={batch}")


def _write(rows: DataFrame, own: str) -> None:
    """Keys by bucket, then their filters. Rows of a bucket lie in one task, a bucket has one file."""
    spark = rows.sparkSession
    rows.repartition("bucket").sortWithinPartitions("bucket", "info_hash").write.mode("overwrite").partitionBy("bucket").parquet(f"{own}/keys")
    held = spark.read.schema("info_hash string, h long, bucket int").parquet(f"{own}/keys")
    held.select("bucket", "h").groupBy("bucket").applyInArrow(_filter, "bucket int, n bigint, bits binary").write.mode("overwrite").parquet(f"{own}/filters")


def _folders(spark: SparkSession, path: str, before: int | None) -> list[str]:
    """The newest base and the whole batches after it, of those before `before`."""
    number = lambda f: int(f.rpartition("=")[2])
    whole = lambda kind: [f for f in folders(spark, path, kind) if folders(spark, f"{f}/filters", "_SUCCESS") and (before is None or number(f) < before)]
    base = max(whole("base="), key=number, default=None)
    return [*([base] if base else []), *(f for f in whole("batch=") if not base or number(f) > number(base))]


def _union(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.read.schema(schema).parquet(p) for p in paths))


def known(spark: SparkSession, path: str, keys: DataFrame, before: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Those of the keys (info_hash) that the store holds, of batches before `before` if it is given; each once."""
    held = _folders(spark, path, before)
    if not held:
        return keys.select("info_hash").where("false")
    filters = _union(spark, [f"{f}/filters" for f in held], "bucket int, n bigint, bits binary")
    maybe = _hashed(keys, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_maybe, "info_hash string, bucket int")
    maybe = stored(maybe, "maybe")
    touched = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # `buckets` numbers at most
    if not touched:
        return maybe.select("info_hash")
    own = _union(spark, [f"{f}/keys" for f in held], "info_hash string, bucket int").where(F.col("bucket").isin(touched))
    return maybe.join(own, ["bucket", "info_hash"], "left_semi").select("info_hash")


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Makes one base of all batches up to `upto`. Readers take it once it is whole; the batches may be cleared after that."""
    held = _folders(spark, path, upto + 1)
    if held:
        _write(_union(spark, [f"{f}/keys" for f in held], "info_hash string, h long, bucket int").dropDuplicates(["bucket", "info_hash"]), f"{path}/base={upto}")


def insert_ignore(rows: DataFrame, path: str, batch: int, blocked: DataFrame, order: list | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows to append, stored: the first of each key, if neither the store's earlier batches nor the block-list have it.
    Their keys become the store's batch. Done again, the same batch gives the same rows."""
    spark = rows.sparkSession
    first = merge.first_of_key(rows, order or ["created_at"])
    old = known(spark, path, first, batch, buckets)
    new = stored(merge.without(merge.without(first, old), blocked), "new")
    add(new, path, batch, buckets)
    return new
