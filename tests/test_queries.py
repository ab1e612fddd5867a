"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodex import queries

SF = os.environ.get("LODEX_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return "null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(queries.SQL[name]).df())


def test_client_keys_of_large_ids(spark, tmp_path):
    """Ids of more than four hexadecimal digits, and none."""
    given = [3, 65535, 65539, 90_003, 540_007, 2**40 + 3, 2**62 + 3, 65536, 65537, 65538, None]
    spark.createDataFrame([(i, u) for i, u in enumerate(given)], "event_id long, user_id long").selectExpr("*", "timestamp_ntz'2024-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(queries.QUERIES["client_keys"](spark, str(tmp_path)).toPandas()) == rows(con.sql(queries.SQL["client_keys"]).df())


def test_plans(spark):
    """No Python worker and no Cartesian product; a page is a top-k; an insert deals each side once."""
    plan = lambda name: queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name in ("search_page", "insert_ignore", "best_seeders", "topk_queue", "listing_links", "batch_numbers", "review_apply", "counter_deltas"):
        p = plan(name)
        assert "CartesianProduct" not in p and "Python" not in p and "Pandas" not in p and "ExistingRDD" not in p, name
    assert "TakeOrderedAndProject" in plan("search_page") and "TakeOrderedAndProject" in plan("topk_queue")
    assert "ReadSchema: struct<doc_id:bigint,text:string" in plan("rule_patterns")
