"""Pages by the histogram and by keyset against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodex.operators import pages, search
from lodex.sources import tables as T

SCHEMA = ", ".join(f"{c} {k}" for c, k in T.LISTING.items())


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    at = [rng.choice([50, 51, rng.randrange(100), rng.randrange(5000), 700]) for _ in range(300)]
    return spark.createDataFrame([(f"{i:03}", f"name {i % 4} x", i, 1, [], t, 0, "clean 1" if i % 9 == 0 else "") for i, t in enumerate(at)], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_all_pages(spark, table, tmp_path):
    pages.write(table, str(tmp_path), 10)
    everything = rows(search.results(table).orderBy(F.desc("created_at"), "info_hash"))
    for size, numbers in ((7, range(1, 46)), (100, (1, 2, 3, 4)), (1000, (1, 4)), (0, (0, 5))):
        for page in numbers:
            p, s = pages.page_number(page, size)
            assert rows(pages.latest(spark, str(tmp_path), page, size, 10)) == everything[(p - 1) * s : p * s], (page, size)


def test_a_page_reads_its_range(spark, table, tmp_path):
    pages.write(table, str(tmp_path), 10)
    page = pages.latest(spark, str(tmp_path), 3, 7, 10)
    low, high, _ = pages.span(spark, str(tmp_path), 14, 7)
    read = table.where((F.col("created_at") >= 10 * low) & (F.col("created_at") < 10 * high + 10)).count()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", page._jdf.queryExecution().executedPlan().toString())[1]
    assert f"GreaterThanOrEqual(created_at,{10 * low})" in pushed and f"LessThan(created_at,{10 * high + 10})" in pushed
    assert 7 <= read <= 30 and page.count() == 7
    read_schema = page._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "files" not in read_schema and "reviewed_at" not in read_schema


def test_keyset_pages_are_the_offset_pages(spark, table):
    for q in ("", "name 1", "clean"):
        last, number = None, 1
        while got := rows(pages.search_after(table, q, last, 20)):
            assert got == rows(search.search(table, q, number, 20))
            last, number = (got[-1][4], got[-1][0]), number + 1
        assert number > 1 and rows(search.search(table, q, number, 20)) == []


def test_no_listings(spark, table, tmp_path):
    pages.write(table.limit(0), str(tmp_path))
    assert rows(pages.latest(spark, str(tmp_path))) == [] and rows(pages.search_after(table.limit(0), "x", (5, "a"))) == []
    pages.write(table.limit(3).withColumn("created_at", F.lit(None).cast("long")), str(tmp_path))
    assert [r[4] for r in rows(pages.latest(spark, str(tmp_path)))] == [0, 0, 0]
