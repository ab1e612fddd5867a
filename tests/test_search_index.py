"""The trigram index against the scan, and what it reads."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodex.operators import search, search_index
from lodex.sources import tables as T

SCHEMA = ", ".join(f"{c} {k}" for c, k in T.LISTING.items())
ASKED = "query_id long, q string, page string, page_size string"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "Gamma", "100%", "ünï", "女優作品", "a_b", "xy", "q", "İstanbul", "beTAlpha", "rare" * 3]
    name = lambda: " ".join(rng.choice(words[:-1]) for _ in range(rng.randrange(6)))
    given = [(f"{i:03}", name() if i % 19 else None, i, 1, [], 1000 + i % 37, 0, name() if i % 5 == 0 else "") for i in range(400)]
    given[7] = ("007", "one rarerarerare name", 7, 1, [], 5, 0, "")
    return spark.createDataFrame(given, SCHEMA)


QUERIES = ["alpha", "BETA gamma", "100%", "ünï", "女優作", "女優", "xy", "q", "", None, "rarerarerare", "absent", "alp absent", "talph", "a_b q", "İst", "ab", "beta xy q gamma alpha ünï 100% a_b extra", "alpha" * 50]


def test_index_equals_scan(spark, table, tmp_path, monkeypatch):
    asked = spark.createDataFrame([(i, q, str(1 + i % 2), "7") for i, q in enumerate(QUERIES)], ASKED)
    for k in range(2):
        search_index.add(table.where(F.col("total_size") % 2 == k), str(tmp_path), k, block_rows=16)
    want = rows(search.search_batch(table, asked))
    assert len(want) > 50 and rows(search_index.search_batch(spark, str(tmp_path), asked)) == want
    for limits in ({"MOST_GRAMS": 0, "MOST_BLOCKS": 0}, {"DEPTH": 1}, {"DEPTH": 9, "FACTOR": 1000}):
        for k, v in limits.items():
            monkeypatch.setattr(search_index, k, v)
        assert rows(search_index.search_batch(spark, str(tmp_path), asked)) == want
    monkeypatch.setattr(search, "MOST_QUERIES", 5)
    assert rows(search_index.search_batch(spark, str(tmp_path), asked)) == want


def test_other_blocks_and_parts_are_not_read(spark, table, tmp_path):
    out = str(tmp_path / "i")
    search_index.add(table, out, block_rows=16)
    asked = spark.createDataFrame([(1, "rarerarerare", "1", "5")], ASKED)
    seg = Path(out) / "segment=0"
    before = len(list(seg.glob("listing/block=*")))
    own = search_index.candidates(spark, str(seg), search.page_parameters(asked).withColumn("grams", F.array(F.lit("rer"))))
    assert [r.query_id for r in own.collect()] == [1]
    block = own.first().block
    for other in seg.glob("listing/block=*"):
        if other.name != f"block={block}":
            for f in other.glob("*.parquet"):
                f.write_bytes(b"not to be read")
    read = spark.read.schema(search_index.LISTING).parquet(f"{seg}/listing").where(f"block = {block}").count()
    got = search_index.search_batch(spark, out, asked).collect()
    assert [(r.total, r.info_hash) for r in got] == [(1, "007")] and before == 25 and read == 16
    needed = {r.part for r in spark.read.parquet(f"{seg}/grams").where("gram in ('rer', 'rar', 'are', 'era')").select("part").collect()}
    for part in seg.glob("postings/part=*"):
        if int(part.name[5:]) not in needed:
            shutil.rmtree(part)
    assert search_index.search_batch(spark, out, asked).count() == 1


def test_trigrams(spark):
    got = spark.createDataFrame([("ABab",), ("ab",), ("",), (None,), ("女優😀x",), ("z" * 5000,)], "s string").select(search_index.trigrams(F.col("s")).alias("g")).collect()
    assert [sorted(r.g) for r in got] == [["aba", "bab"], [], [], [], ["優😀x", "女優😀"], ["zzz"]]


def test_empty_index(spark, table, tmp_path):
    search_index.add(table.limit(0), str(tmp_path))
    asked = spark.createDataFrame([(1, "alpha", None, None), (2, "", None, None)], ASKED)
    assert search_index.search_batch(spark, str(tmp_path), asked).count() == 0
