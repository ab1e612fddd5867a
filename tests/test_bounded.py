"""Bounded streams against plain queues, over several micro-batches."""

import random
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lodex import queries
from lodex.streaming import bounded
from tests.test_jobs import files


def collected(rows, tmp_path, n=None, **trigger):
    """The rows of all micro-batches; with `n`, once there are so many (a stream with timers doesn't end by itself)."""
    got = []
    stream = rows.writeStream.foreachBatch(lambda batch, k: got.extend((k, *r) for r in batch.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(**(trigger or {"availableNow": True})).start()
    end = time.time() + 90
    while stream.isActive and time.time() < end and (n is None or len(got) < n):
        time.sleep(0.2)
    assert stream.exception() is None
    stream.stop()
    return got


def test_oldest_keys_are_forgotten(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(40)}" if rng.random() < 0.95 else None, i) for i in range(600)]
    keys = files(spark, tmp_path, [rows[:200], rows[200:210], rows[210:]], "key string, seq long")
    got = collected(bounded.dedupe_oldest(keys, F.col("seq") % 3, 30, 3), tmp_path)
    held, want = {0: [], 1: [], 2: []}, []
    for k, i in rows:
        own = held[i % 3]
        if k is not None and k not in own:
            own.append(k)
            want.append((k, i))
            del own[:-10]
    assert sorted(r[1:] for r in got) == sorted(want) and len({r[0] for r in got}) == 3
    assert max(sum(k == x for x, _ in want) for k, _ in want) > 3  # they come again


def test_requests_fill_over_micro_batches(spark, tmp_path):
    rows = [(f"k{i}", i) for i in range(100)]
    keys = files(spark, tmp_path, [rows[:25], rows[25:27], rows[27:]], "hash string, seq long")
    got = collected(bounded.request_batches(keys, F.col("seq") % 2, 10, 3600.0), tmp_path, 100, processingTime="100 milliseconds")
    want = [(i % 2, i // 2 // 10, i // 2 % 10 + 1, f"k{i}", i, False) for i in range(100)]
    assert sorted(r[1:] for r in got) == sorted(want) and len({r[0] for r in got}) > 1


def test_what_waits_goes_out_after_a_while(spark, tmp_path):
    rows = [(f"k{i}", i) for i in range(23)]
    keys = files(spark, tmp_path, [rows[:4], rows[4:]], "hash string, seq long")
    got = collected(bounded.request_batches(keys, F.lit(0), 10, 1.0), tmp_path, 23, processingTime="500 milliseconds")
    sizes = {}
    for _, _, batch, i, _, _, late in got:
        sizes.setdefault(batch, []).append((i, late))
    assert sorted(r[5] for r in got) == list(range(23))
    for own in sizes.values():
        assert sorted(i for i, _ in own) == list(range(1, len(own) + 1)) and len({late for _, late in own}) == 1
        assert len(own) == 10 or own[0][1]  # short by time only


class Held:
    """A state in memory that counts what is asked of it."""

    def __init__(self):
        self.values, self.asked = [], 0

    def exists(self):
        self.asked += 1
        return bool(self.values)

    def get(self):
        self.asked += 1
        return iter(self.values)

    def put(self, values):
        self.asked += 1
        self.values = values


class Handle:
    def __init__(self):
        self.held = Held()

    def getListState(self, name, schema):  # noqa: N802
        return self.held


def test_a_micro_batch_reads_and_writes_the_remembered_keys_once():
    handle, own = Handle(), bounded.Oldest(50)
    own.init(handle)
    for start in (0, 30_000):
        rows = pd.DataFrame({"key": [f"k{i % 100}" for i in range(start, start + 30_000)], "seq": range(start, start + 30_000)})
        got = pd.concat(own.handleInputRows((0,), iter([rows[20_000:], rows[:20_000]]), None))
        assert got["seq"].tolist() == list(range(start, start + 30_000)) and len(handle.held.values) == 50
    assert handle.held.asked <= 6


def test_fed_files_are_bounded_in_rows_and_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch", lambda _, what: f"{tmp_path}/{what}-{len(list(tmp_path.iterdir()))}")
    rows = spark.range(5000).selectExpr("5000 - id AS n", "if(id % 1000 = 7, null, id) AS id")
    queries.fed(rows, "n", most=500)
    parts = sorted((r[0], r[1], r[2]) for r in spark.read.parquet(f"{tmp_path}/fed-0").groupBy(F.input_file_name()).agg(F.min("n"), F.max("n"), F.count("*")).select("min(n)", "max(n)", "count(1)").collect())
    assert len(parts) >= 8 and max(n for *_, n in parts) <= 1000 and sum(n for *_, n in parts) == 5000
    assert all(a[1] < b[0] for a, b in zip(parts, parts[1:]))
    queries.fed(rows, "id")
    assert spark.read.parquet(f"{tmp_path}/fed-2").count() == 5000  # rows without a place, too


class Number:
    """A value in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_requests_leave_a_task_in_parts():
    """However many a micro-batch fills, a task holds no more than some thousand of them as Python rows."""
    own = bounded.Requests(70, 3600.0)
    own.next = Number()
    rows = pa.table({"hash": pa.array([f"k{i}" for i in range(35_000)], pa.large_string()), "seq": pa.array(range(35_000), pa.int64())})
    parts = list(own._sent(3, rows, False))
    got = pd.concat(parts, ignore_index=True)
    assert len(parts) > 1 and max(map(len, parts)) <= 10_000 and own.next.value == (500,)
    assert got["batch"].tolist() == [i // 70 for i in range(35_000)] and got["i"].tolist() == [i % 70 + 1 for i in range(35_000)]
    assert got["hash"].tolist() == rows["hash"].to_pylist() and got["seq"].tolist() == list(range(35_000)) and set(got["shard"]) == {3}
