"""Streams: key dedupe, indexing with counters, the rank queue, and token buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodex.functions import keys
from lodex.operators import keystore, rank, rules
from lodex.operators.requests import BURST, RATE, level
from lodex.sources.tables import FILES

#: Shards of the keys that a stream keeps a state of.
SHARDS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).options(pathGlobFilter=f"{name}.parquet", **options).parquet(sf_dir)


def dedupe(keys: DataFrame, key: str = "info_hash", ts: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """The first row of each key within the horizon. State is bounded by time: a key seen again later may come again."""
    return keys.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def index(records: DataFrame, path: str, blocked: Callable[[SparkSession], DataFrame], rule: rules.Rules | None, checkpoint: str, buckets: int = keystore.BUCKETS):
    """Starts the indexing stream: records are screened, counted by route and inserted if new and not blocked.

    Listings go to <path>/listing/batch=n, counter deltas to <path>/counters/batch=n, keys to the key store <path>/keys; a batch
    that is run again after a failure writes the same folders again. What earlier batches inserted is asked of the key
    store, so a batch costs what it brings. Without rules (bare keys), each record counts as seen and is inserted. Records
    are dealt out before they are screened, as a batch of one file would be one task's work.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rules.screened(batch.repartition(tasks), rule) if rule else batch.withColumn("route", F.lit("seen"))
        rows = rows.select(*batch.columns, "route").persist()
        passed = rows.where(F.col("route").isin("fetched", "seen")).drop("route")
        new = keystore.insert_ignore(passed, f"{path}/keys", n, blocked(spark), ["created_at"], buckets)
        new.write.mode("overwrite").parquet(f"{path}/listing/batch={n}")
        inserted = new.agg(F.lit("inserted").alias("key"), F.count("*").alias("delta"))
        rows.groupBy(F.col("route").alias("key")).agg(F.count("*").alias("delta")).unionByName(inserted).coalesce(1).write.mode("overwrite").parquet(f"{path}/counters/batch={n}")
        rows.unpersist()

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bare_records(keys: DataFrame, key: str = "info_hash", ts: str = "ts") -> DataFrame:
    """Records of keys alone, as index() takes them without rules: the key is the name, and the size is 1."""
    c = F.col(key)
    return keys.select(c.alias("info_hash"), c.alias("name"), F.lit(1).cast("long").alias("total_size"), F.lit(0).alias("file_count"), F.array().cast(FILES).alias("files"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("created_at"))


def triggered(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def ranked(items: DataFrame, path: str, checkpoint: str, capacity: int = rank.CAPACITY, every: str | None = None, hand_out: int = 0):
    """Starts the ranking stream: each batch (hash, seeders, seq) is merged into the queue of the last, and the best
    `capacity` stay. Of these the best `hand_out` leave, to <path>/out/batch=n; the others wait in <path>/queue/batch=n.
    What waits when nothing more comes is handed out by drained()."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = spark.read.schema(batch.schema).parquet(f"{path}/queue/batch={n - 1}") if n else spark.createDataFrame([], batch.schema)
        best = rank.queue(last, batch, capacity).persist()  # `capacity` rows
        best.limit(hand_out).write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        best.offset(hand_out).write.mode("overwrite").parquet(f"{path}/queue/batch={n}")
        best.unpersist()

    return items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**triggered(every)).start()


def drained(spark: SparkSession, path: str, schema, n: int) -> DataFrame:
    """What waits after batch `n` of a ranking stream, best first."""
    return rank.queue(spark.read.schema(schema).parquet(f"{path}/queue/batch={n}"))


def batched(keys: DataFrame, path: str, checkpoint: str, order: list, size: int = rank.BATCH, every: str | None = "2 seconds"):
    """Starts a stream that parts keys into requests of `size`, or of what came within `every`: each micro-batch is numbered
    (batch from 0, i from 1) in the given order and written to <path>/part=n."""

    def run(batch: DataFrame, n: int) -> None:
        rank.numbered(batch, order, size).write.mode("overwrite").parquet(f"{path}/part={n}")

    return keys.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**triggered(every)).start()


def per_key(step: Callable, until: Callable | None):
    """A function of a shard of keys, its rows of a micro-batch (key and numbers) and its state: of each key, two numbers.

    `step` takes a key, its rows in order and its two numbers (None for a new key), and gives the two numbers and a list of
    results. Once the watermark is at `until` of the two numbers (seconds), a key is forgotten.
    """

    def run(_, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (a, b) for k, a, b in zip(*state.get, strict=True)} if state.exists else {}
        given: dict[str | None, list] = {}
        for part in rows:
            own = part["key"].astype(object)
            numbers = [part[c].tolist() for c in part.columns if c not in ("shard", "key", "ts")]
            for k, *row in zip(own.where(own.notna(), None).tolist(), *numbers, strict=True):
                given.setdefault(k, []).append(row)
        results = []
        for k, found in given.items():
            held[k], more = step(k, sorted(found), held.get(k))
            results += more
        if until:
            now = state.getCurrentWatermarkMs()
            ends = {k: int(until(*pair) * 1000) + 1 for k, pair in held.items()}
            held = {k: pair for k, pair in held.items() if ends[k] > now}
        if held:
            state.update((list(held), [a for a, _ in held.values()], [b for _, b in held.values()]))
            if until:
                state.setTimeoutTimestamp(min(ends[k] for k in held))
        elif state.exists:
            state.remove()
        if results:
            yield pd.DataFrame(results)

    return run


def sharded(rows: DataFrame, step: Callable, until: Callable | None, out: str, shards: int) -> DataFrame:
    """What `step` gives for rows (key, ts, numbers), as `out` names it. The keys lie in shards by hash, of which each is
    one call and one state a micro-batch: a call for each key costs more than its rows."""
    kind = rows.schema["key"].dataType
    given = rows.withColumns({"key": F.col("key").cast("string"), "shard": F.pmod(F.xxhash64("key"), F.lit(shards))})
    timeout = GroupStateTimeout.EventTimeTimeout if until else GroupStateTimeout.NoTimeout
    told = given.groupBy("shard").applyInPandasWithState(per_key(step, until), f"key string, {out}", "keys array<string>, first array<double>, second array<double>", "update", timeout)
    return told.withColumn("key", F.col("key").cast(kind))


def buckets(log: DataFrame, rate: float = RATE, burst: float = BURST, idle: float | None = None, late: str = "1 minute", shards: int = SHARDS) -> DataFrame:
    """client, allowed, rejected of each batch of a log stream (client, ts): a token bucket for each client, of which the state
    has the tokens and the last time.

    With `idle` the state is bounded by the clients of the last `idle` seconds of the log, and requests that come more
    than `late` behind it are dropped; a forgotten client's bucket would be full again. A micro-batch's requests of one shard
    of clients are sorted in memory; limit the files of a micro-batch (maxFilesPerTrigger) where one client may have any number.
    """

    def step(client, rows, pair):
        tokens, last = pair or (burst, None)
        yes = 0
        for (t,) in rows:
            tokens, last = level(tokens, last, t, rate, burst, idle), t
            if tokens >= 1:
                tokens, yes = tokens - 1, yes + 1
        return (tokens, last), [{"key": client, "allowed": yes, "rejected": len(rows) - yes}]

    rows = log.select(F.col("client").alias("key"), F.col("ts").cast("timestamp").alias("ts")).where("ts is not null")
    rows = (rows.withWatermark("ts", late) if idle else rows).withColumn("t", F.col("ts").cast("double"))
    return sharded(rows, step, (lambda _, last: last + idle) if idle else None, "allowed long, rejected long", shards).withColumnRenamed("key", "client")


def due_nodes(observations: DataFrame, reserve: float = 60.0, forget: float = 7200.0, late: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """addr, at (seconds) of the nodes to ask, from a stream of sightings and replies (addr, port, ts, answered, interval_s).

    A sighting of a node that is due offers it and keeps it from being offered for `reserve` seconds; a reply keeps it for
    its interval, from a minute to two hours. Port 0 is skipped. A node is forgotten `forget` seconds of the stream's
    time after it was due, which bounds the state by time instead of by a number of nodes; it would be offered anyway
    then. Rows that come more than `late` behind are dropped.
    """

    def step(addr, rows, pair):
        when, t, offered = pair[0] if pair else 0.0, 0.0, []
        for t, wait in rows:
            if wait > 0:
                when = t + wait
            elif t >= when:
                offered.append({"key": addr, "at": t})
                when = t + reserve
        return (when, t), offered

    wait = F.when(F.col("answered"), keys.interval(F.col("interval_s"))).otherwise(0).cast("double")
    rows = observations.where("port <> 0").select(F.col("addr").alias("key"), F.col("ts").cast("timestamp").alias("ts"), wait.alias("wait")).withWatermark("ts", late)
    rows = rows.select("key", "ts", F.col("ts").cast("double").alias("t"), "wait").where("ts is not null")
    return sharded(rows, step, lambda when, last: max(when, last) + forget, "at double", shards).withColumnRenamed("key", "addr")
