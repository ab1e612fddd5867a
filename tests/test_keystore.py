"""The key store against plain sets, and what it reads."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from lodex.operators import keystore
from tests.test_jobs import SCHEMA, blocked, listings


def keys(spark, found):
    return spark.createDataFrame([(k,) for k in found], "info_hash string")


def test_known_keys_over_batches(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path)
    assert keystore.known(spark, path, keys(spark, ["a"])).count() == 0
    held = []
    for n in range(4):
        own = {f"{rng.randrange(3000):x}" for _ in range(400)}
        keystore.add(keys(spark, [*own, *list(own)[:9], None]), path, n, buckets=8)
        held.append(own)
    asked = [f"{i:x}" for i in range(3000)] + [None, "0", "0"]
    for before in (None, 2, 0):
        got = sorted(r.info_hash for r in keystore.known(spark, path, keys(spark, asked), before, buckets=8).collect())
        assert got == sorted(set().union(*held[:before] if before is not None else held))
    keystore.compact(spark, path, 2)
    for n in range(3):  # the base stands for them
        (tmp_path / f"batch={n}" / "filters" / "_SUCCESS").unlink()
    assert sorted(r.info_hash for r in keystore.known(spark, path, keys(spark, asked), buckets=8).collect()) == sorted(set().union(*held))
    (tmp_path / "base=2" / "filters" / "_SUCCESS").unlink()  # a base that isn't whole
    assert {r.info_hash for r in keystore.known(spark, path, keys(spark, asked), buckets=8).collect()} == held[3]


def test_only_touched_buckets_are_read(spark, tmp_path):
    path, own = str(tmp_path), [f"k{i}" for i in range(2000)]
    keystore.add(keys(spark, own), path, 0, buckets=64)
    buckets = {r.info_hash: r.bucket for r in keystore._hashed(keys(spark, own), 64).collect()}
    asked = ["k5", *(f"new{i}" for i in range(10))]
    maybe = keystore._hashed(keys(spark, asked), 64).groupBy("bucket").cogroup(spark.read.parquet(f"{path}/batch=0/filters").groupBy("bucket")).applyInArrow(keystore._maybe, "info_hash string, bucket int")
    touched = {r.bucket for r in maybe.collect()}
    assert buckets["k5"] in touched and len(touched) <= 4
    for folder in Path(path).glob("batch=0/keys/bucket=*"):
        if int(folder.name[7:]) not in touched:
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"not to be read")
    assert [r.info_hash for r in keystore.known(spark, path, keys(spark, asked), buckets=64).collect()] == ["k5"]


def test_filters_hold_all_their_keys_and_few_others(spark, tmp_path):
    keystore.add(keys(spark, [f"k{i}" for i in range(20_000)]), str(tmp_path), 0, buckets=4)
    filters = spark.read.parquet(f"{tmp_path}/batch=0/filters").groupBy("bucket")
    hits = lambda found: keystore._hashed(keys(spark, found), 4).groupBy("bucket").cogroup(filters).applyInArrow(keystore._maybe, "info_hash string, bucket int").count()
    assert hits([f"k{i}" for i in range(5000)]) == 5000 and hits([f"n{i}" for i in range(5000)]) < 100


def test_insert_ignore(spark, tmp_path):
    bad, path = blocked(spark, "zz"), str(tmp_path)
    first = listings(spark, ("aa", "old", 5), ("aa", "first", 2), ("zz", "x", 1), (None, "no key", 1))
    for _ in range(2):  # the same batch again
        got = keystore.insert_ignore(first, path, 0, bad, buckets=4)
        assert sorted((str(r.info_hash), r.name) for r in got.collect()) == [("None", "no key"), ("aa", "first")]
    got = keystore.insert_ignore(listings(spark, ("aa", "again", 1), ("bb", "y", 9)), path, 1, bad, buckets=4)
    assert [(r.info_hash, r.name) for r in got.collect()] == [("bb", "y")]
    assert keystore.insert_ignore(spark.createDataFrame([], SCHEMA), path, 2, bad, buckets=4).count() == 0
    assert keystore.known(spark, path, keys(spark, ["aa", "bb", "cc"]).withColumn("other", F.lit(1)), buckets=4).count() == 2
