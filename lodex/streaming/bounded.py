"""Streams whose state is bounded in number: dedupe with the oldest keys forgotten, and requests by size or time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodex.operators import rank

#: Keys that a dedupe remembers over all shards, and seconds after which a request goes out short.
REMEMBERED, WAIT = 1 << 18, 2.0
#: Rows that a task hands on at once.
STEP = 10_000


def _in_order(rows: Iterator[pd.DataFrame], text: str) -> pa.Table:
    """A micro-batch's rows of a shard (`text`, seq), by seq, as Arrow columns: a few bytes a row beside its text."""
    kind = pa.schema([(text, pa.large_string()), ("seq", pa.int64())])
    return pa.concat_tables([kind.empty_table(), *(pa.Table.from_pandas(part[[text, "seq"]], kind, preserve_index=False) for part in rows)]).sort_by("seq")


class Oldest(StatefulProcessor):
    """A shard's remembered keys, the oldest first. A key that isn't remembered is passed on and remembered, and the oldest beyond
    the capacity is forgotten. The state is read and written once a micro-batch, not for each key."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "key string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = deque(k for (k,) in self.held.get()) if self.held.exists() else deque()
        known = set(order)
        for part in _in_order(rows, "key").to_batches(max_chunksize=STEP):
            new = []
            for k, seq in zip(part["key"].to_pylist(), part["seq"].to_pylist(), strict=True):
                if k in known:
                    continue
                known.add(k)
                order.append(k)
                if len(order) > self.capacity:
                    known.remove(order.popleft())
                new.append((k, seq))
            yield pd.DataFrame({"key": [k for k, _ in new], "seq": [s for _, s in new]}).astype({"key": object, "seq": "int64"})
        self.held.put([(k,) for k in order])

    def close(self) -> None:
        pass


def dedupe_oldest(keys: DataFrame, shard, remembered: int = REMEMBERED, shards: int = 64) -> DataFrame:
    """key, seq of the keys (key, seq) that aren't remembered: of each shard (a column; 0 to `shards` - 1) the last
    `remembered` / `shards` keys that were passed on are, so a key that comes after as many others comes again. In order of
    seq within a micro-batch; null keys are left out. The session needs the RocksDB state store, which holds each
    remembered key; a micro-batch's rows of a shard are sorted in memory."""
    rows = keys.where("key is not null").select(shard.cast("long").alias("shard"), F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("shard").transformWithStateInPandas(Oldest(max(1, remembered // shards)), "key string, seq long", "Append", "None")


class Requests(StatefulProcessor):
    """A shard's waiting keys and the number of its next request. As many as fill requests go out at once; a timer sends the rest
    when its first key has waited long enough."""

    def __init__(self, size: int, wait: float):
        self.size, self.wait = size, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "hash string, seq long")
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        pending = pa.concat_tables([held, _in_order(rows, "hash")])
        full = pending.num_rows // self.size * self.size
        rest = pending.slice(full)
        if rest.num_rows:
            self.waiting.put(list(zip(rest["hash"].to_pylist(), rest["seq"].to_pylist(), strict=True)))
        else:
            self.waiting.clear()
        if full or not held.num_rows:  # the first that waits is another one
            self._restart(timerValues.getCurrentProcessingTimeInMs() if rest.num_rows else None)
        yield from self._sent(key[0], pending.slice(0, full), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.waiting.clear()
        yield from self._sent(key[0], held, True)

    def _held(self) -> pa.Table:
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        return pa.table({"hash": pa.array([h for h, _ in rows], pa.large_string()), "seq": pa.array([s for _, s in rows], pa.int64())})

    def _restart(self, now: int | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if now is not None:
            self.handle.registerTimer(now + int(self.wait * 1000))

    def _sent(self, shard: int, rows: pa.Table, late: bool) -> Iterator[pd.DataFrame]:
        n = self.next.get()[0] if self.next.exists() else 0
        self.next.update((n + -(-rows.num_rows // self.size),))
        for start in range(0, rows.num_rows, STEP):
            own = rows.slice(start, STEP)
            at = np.arange(start, start + own.num_rows)
            yield pd.DataFrame({"shard": shard, "batch": n + at // self.size, "i": (at % self.size + 1).astype("int32"), "hash": pd.Series(own["hash"].to_pylist(), dtype=object), "seq": own["seq"].to_numpy(), "late": late})

    def close(self) -> None:
        pass


def request_batches(keys: DataFrame, shard, size: int = rank.BATCH, wait: float = WAIT) -> DataFrame:
    """shard, batch (from 0 in each shard), i (from 1), hash, seq, late of keys (hash, seq): requests of `size` keys, filled over
    micro-batches in order of seq within each; what has waited `wait` seconds goes out short (late), with the next trigger.
    At most `size` - 1 keys of a shard wait. The session needs the RocksDB state store. Because of its timers the stream goes on
    until it is stopped, whatever the trigger."""
    rows = keys.select(shard.cast("long").alias("shard"), F.col("hash").cast("string").alias("hash"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("shard").transformWithStateInPandas(Requests(size, wait), "shard long, batch long, i int, hash string, seq long, late boolean", "Append", "ProcessingTime")
