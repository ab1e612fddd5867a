"""Request-log accounting: client keys and a token bucket for each."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodex.sources.shared import stored

RATE, BURST, IDLE = 3.0, 30.0, 600.0


def _address(s: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    try:
        a = ipaddress.ip_address(s)
    except ValueError:
        return None
    return a.ipv4_mapped or a if isinstance(a, ipaddress.IPv6Address) else a


_OWN = [ipaddress.ip_network(n) for n in ("127.0.0.0/8", "::1/128", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "169.254.0.0/16", "fe80::/10")]


def key_of(remote: str, forwarded: str, real: str) -> str:
    """The address a request counts for; IPv6 addresses count by /64."""
    host = remote[1:].partition("]")[0] if remote.startswith("[") else remote.rpartition(":")[0] if remote.count(":") == 1 else remote
    peer = _address(host)
    if peer is None:
        return host
    own = lambda a: any(a in n for n in _OWN if n.version == a.version)
    client = peer
    if own(peer):
        hops = [_address(h.strip()) for h in reversed(forwarded.split(","))] if forwarded else []
        outer = next((h for h in hops if h is None or not own(h)), None)
        client = outer or _address(real.strip()) or peer
    return str(client) if client.version == 4 else str(ipaddress.ip_network((int(client), 64), strict=False))


def client_keys(log: DataFrame) -> DataFrame:
    """The log's columns and client; remote, xff and real_ip may be null."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            given = rows[["remote", "xff", "real_ip"]].fillna("")
            yield rows.assign(client=[key_of(*r) for r in given.itertuples(index=False)])

    return log.mapInPandas(run, T.StructType([*log.schema.fields, T.StructField("client", T.StringType())]))


def bucket_audit(log: DataFrame, rate: float = RATE, burst: float = BURST, idle: float | None = IDLE) -> DataFrame:
    """client, allowed, rejected over a log (client, ts): a bucket fills at `rate` a second up to `burst`; a request takes one
    token if there is one; after more than `idle` seconds the bucket is full again.

    After a gap that fills the bucket, or an idle one, nothing before it counts: a client's log parts into independent sections,
    which many tasks take. A task keeps two numbers for the section at hand, however long it is. Requests without a time are
    left out; those without a client are one client's.
    """
    kind = log.schema["client"].dataType
    rows = sections(log.select("client", F.col("ts").cast("timestamp").cast("double").alias("t")).where("t is not null"), rate, burst, idle)
    rows = rows.repartition("client", "part", "section").sortWithinPartitions("client", "part", "section", "t")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own, tokens, last, yes, no = False, None, burst, None, 0, 0
        for batch in it:
            done: list[tuple] = []
            for *key, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not known or key != own:
                    if known:
                        done.append((own[0], yes, no))
                    known, own, tokens, last, yes, no = True, key, burst, None, 0, 0
                tokens = level(tokens, last, t, rate, burst, idle)
                last = t
                if tokens >= 1:
                    tokens, yes = tokens - 1, yes + 1
                else:
                    no += 1
            yield counted(done, batch.schema.field(0).type)
        if known:
            yield counted([(own[0], yes, no)], to_arrow_type(kind))

    told = rows.mapInArrow(run, T.StructType([T.StructField("client", kind), T.StructField("allowed", T.LongType()), T.StructField("rejected", T.LongType())]))
    return told.groupBy("client").agg(F.sum("allowed").alias("allowed"), F.sum("rejected").alias("rejected"))


def sections(log: DataFrame, rate: float, burst: float, idle: float | None) -> DataFrame:
    """client, part, section, t of a log (client, t in seconds): rows of one section belong together, and a section begins with
    a full bucket.

    The log is ranged by client and time and stored. Within a part, a row begins a section if the gap before it fills the
    bucket; a client's first row in a part takes the last time of the part before. What comes before a part's first beginning
    belongs to the last section that began in a part before; a table of a row for each client and part tells which.
    """
    rows = stored(log.select("client", "t").repartitionByRange("client", "t").withColumn("part", F.spark_partition_id()), "log")
    by_client = Window.partitionBy("client").orderBy("part")
    ends = rows.groupBy("client", "part").agg(F.max("t").alias("end"))
    ends = ends.select("client", "part", F.lag("end").over(by_client).alias("before"))
    gap = F.col("t") - F.coalesce(F.lag("t").over(Window.partitionBy("client", "part").orderBy("t")), F.col("before"))
    new = gap.isNull() | (gap * F.lit(rate) >= F.lit(burst)) | (gap > F.lit(idle) if idle else F.lit(False))
    met = rows.alias("r").join(ends.alias("e"), F.col("r.client").eqNullSafe(F.col("e.client")) & (F.col("r.part") == F.col("e.part"))).select("r.client", "r.t", "r.part", "before")
    count = F.sum(new.cast("long")).over(Window.partitionBy("client", "part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    placed = stored(met.withColumn("section", count), "sections")
    began = placed.groupBy("client", "part").agg(F.max("section").alias("most"))  # sections that began in the part
    last = F.last(F.when(F.col("most") > 0, F.struct("part", "most")), ignorenulls=True).over(by_client.rowsBetween(Window.unboundedPreceding, -1))
    began = began.select(F.col("client").alias("_client"), F.col("part").alias("_part"), last.alias("owner"))
    carried = placed.join(began, F.col("client").eqNullSafe(F.col("_client")) & (F.col("part") == F.col("_part")))
    of = lambda own, name: F.when(F.col("section") > 0, F.col(own)).otherwise(F.col(f"owner.{name}"))
    return carried.select("client", of("part", "part").alias("part"), of("section", "most").alias("section"), "t")


def level(tokens: float, last: float | None, now: float, rate: float, burst: float, idle: float | None) -> float:
    """A bucket's tokens before a request."""
    if last is None or (idle and now - last > idle):
        return burst
    return min(burst, tokens + (now - last) * rate)


def counted(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names=["client", "allowed", "rejected"])
