"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts with equal shingle sets (five words each) make a class; the join runs between classes. MinHash bands put classes
into buckets. Within a bucket, MinHash values are compared sixteen at a time; a pair is dropped once the posterior
probability (uniform prior) that its similarity reaches the threshold is below the tolerance. What survives is used only
to connect classes: a class already connected isn't compared again, so a bucket of m near copies takes about m
comparisons and gives m - 1 edges. Large buckets are dealt in blocks, each pair of blocks a group of its own. Connected
classes are then verified exactly, all pairs of a component, from their texts; again in pairs of blocks. Only the links'
number by class and connecting edges leave a group, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.common import HashCache, batches, mixed, shingles, stored, word_hashes, words

THRESHOLD, WORDS = 0.8, 5
#: 128 MinHash values in 32 bands of four: a pair of similarity 0.8 shares no band with a chance of 5e-8.
BANDS, ROWS = 32, 4
TOLERANCE, STEP = 1e-5, 16
#: Members of a bucket's block, of a component's block, and rows of a group of small buckets or components.
BUCKET_BLOCK, VERIFY_BLOCK, SHARD_ROWS = 1024, 512, 200
#: Shingles of a component's block, and edges by which a node may be a hub, at least.
BLOCK_SHINGLES, HEAVY = 2_000_000, 100

_A = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mixed(_A + np.uint64(0x632BE59BD9B4E019))


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 128 16-bit MinHash values for each set of shingle hashes; a set must not be empty."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint16)
    for i, s in enumerate(sets):
        low = np.full(BANDS * ROWS, ~np.uint64(0))
        for at in range(0, len(s), 4096):
            x = s[at : at + 4096, None] * _A
            x += _B
            x ^= x >> np.uint64(32)
            np.minimum(low, x.min(axis=0), out=low)
        out[i] = (mixed(low) >> np.uint64(48)).astype(np.uint16)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, one column each."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(sig), axis=0)
    for r in range(ROWS):
        key = mixed(key * np.uint64(65537) + parts[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """By number of compared values n = 16, 32, ...: the fewest equal ones for which the posterior probability of reaching
    the threshold is at least the tolerance. With a uniform prior it is P(Binomial(n + 1, threshold) <= matches)."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of `others` are not dropped against `one`, values compared step by step."""
    alive, equal = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, m in enumerate(least):
        part = slice(STEP * k, STEP * (k + 1))
        equal = equal + (others[alive, part] == one[part]).sum(axis=1)
        keep = equal >= m
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    out = np.zeros(len(others), bool)
    out[alive] = True
    return out


def connect(sig: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """Edges that connect the rows as the surviving pairs do: every row not yet reached is compared with each reached."""
    left, edges = np.arange(len(sig)), []
    while len(left):
        work, left = [left[0]], left[1:]
        while work and len(left):
            x = work.pop()
            hit = survivors(sig[x], sig[left], least)
            edges += [(x, y) for y in left[hit]]
            work += list(left[hit])
            left = left[~hit]
    return edges


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, set (a 128-bit hash of the shingle set), n (its size) and sig (MinHash values) of every row; no
    shingles: n 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches(it):
            sets = [shingles(word_hashes(cache, words(t)), WORDS) for t in batch.column(2).to_pylist()]
            sig = iter(minhash([s for s in sets if len(s)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array([next(sig).tobytes() if len(s) else b"" for s in sets], pa.binary())], names=["id", "text_hash", "set", "n", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), _text_hash(text_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, f"id {kind}, text_hash long, set binary, n int, sig binary")


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash")


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, n (members), node: the bands that several classes share; of bands with equal members, one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "node"])

    rows = nodes.where("n > 0").select("node", "sig").mapInArrow(run, "key long, node long")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    keys = keys.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    return rows.join(keys, "key").select("key", "n", "node")


def _dealt(rows: DataFrame, block: int, own: bool) -> DataFrame:
    """Rows (key, n, node) in groups: a key of up to `block` members is whole, others are dealt into blocks, of which each
    pair is a group (and, if `own`, each block by itself). Adds a and b, the group's blocks, part, the row's block,
    and shard, by which small groups share a task."""
    n = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("part")) | F.lit(own) | (F.col("blocks") == 1))
    rows = rows.withColumn("blocks", n).withColumn("part", part).withColumn("other", F.explode(others))
    rows = rows.withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).drop("blocks", "other")
    shards = max(1, rows.count() // SHARD_ROWS)
    return rows.withColumn("shard", F.pmod(F.xxhash64("key", "a", "b"), F.lit(shards)).cast("int"))


def _connected(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes, from rows with key, a, b, node, sig and shard."""
    least = least_matches()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, group in part.groupby(["key", "a", "b"], sort=False):
            node = group["node"].to_numpy()
            sig = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(-1, BANDS * ROWS)
            out += [(node[x], node[y]) for x, y in connect(sig, least)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("shard").applyInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node with an edge; edges are pairs (a, b) of longs.

    Alternates large-star and small-star steps, each a minimum by node and a join, until nothing changes. Each step is
    a table in the shared folder.
    """
    tasks, heavy = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), HEAVY
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == before:
            break
        heavy = heavy if before else max(HEAVY, now.n // (2 * tasks))  # rounds never add edges; one number, one compiled plan
        before = now
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("degree"))
        large = stored(_joined(both.where("b > a"), least, heavy).select(F.col("b").alias("a"), F.col("m").alias("b")), "stars")
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = _joined(large, down, heavy).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b")))
        e = stored(small.distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _joined(rows: DataFrame, least: DataFrame, heavy: int) -> DataFrame:
    """Rows (a, b) with m of their node a. Nodes of over `heavy` rows are broadcast, so that a hub's rows stay where they
    are: as `heavy` is at least a set part of all rows, there are at most about four times as many hubs as shuffle tasks."""
    hubs = F.broadcast(least.where(F.col("degree") > heavy).select("a", "m"))
    others = rows.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("degree") <= heavy).select("a", "m"), "a")
    return others.select("a", "b", "m").union(rows.join(hubs, "a").select("a", "b", "m"))


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of `left` shares with each of `right` (indices into `sets`)."""
    if len(sets) <= 6:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left], float).reshape(len(left), len(right))
    owner, flat = np.repeat(np.arange(len(sets)), list(map(len, sets))), np.concatenate(sets)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times[code] > 1
    column = (np.cumsum(times > 1) - 1)[code[often]]
    owner, width = owner[often], int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        grid = np.zeros((len(sets), min(4096, width - at)), np.float32)
        grid[owner[lo:hi], column[lo:hi] - at] = 1
        out += grid[left] @ grid[right].T
    return out


def _verified(rows: DataFrame) -> DataFrame:
    """node, other, links: for each group, every node's number of links in it (other is null), and edges (node, other) that
    connect the linked nodes."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        cache, out = HashCache(), []
        for (_, a, b), group in part.groupby(["key", "a", "b"], sort=False):
            node, side = group["node"].to_numpy(), group["part"].to_numpy()
            sets = [shingles(word_hashes(cache, words(t)), WORDS) for t in group["text"]]
            size = np.array(list(map(len, sets)), float)
            left, right = (np.flatnonzero(side == a), np.flatnonzero(side == b)) if a != b else (np.arange(len(node)),) * 2
            if not (len(left) and len(right)):
                continue
            common = shared_counts(sets, left, right)
            linked = common >= THRESHOLD * (size[left][:, None] + size[right][None, :] - common) - 1e-9
            if a == b:
                np.fill_diagonal(linked, False)
                out += [(node[i], None, int(k)) for i, k in zip(left, linked.sum(axis=1), strict=True) if k]
            else:
                out += [(node[i], None, int(k)) for i, k in zip(left, linked.sum(axis=1), strict=True) if k]
                out += [(node[i], None, int(k)) for i, k in zip(right, linked.sum(axis=0), strict=True) if k]
            # A forest of the links: breadth first, each node once.
            near = np.zeros((len(node), len(node)), bool)
            near[np.ix_(left, right)] = linked
            near |= near.T
            todo = np.ones(len(node), bool)
            for start in range(len(node)):
                if not todo[start]:
                    continue
                todo[start], work = False, [start]
                while work:
                    x = work.pop()
                    new = np.flatnonzero(near[x] & todo)
                    todo[new] = False
                    work += list(new)
                    out += [(node[x], node[y], 0) for y in new]
        return pd.DataFrame({"node": pd.Series([o[0] for o in out], dtype="int64"), "other": pd.Series([o[1] for o in out], dtype="Int64"), "links": pd.Series([o[2] for o in out], dtype="int64")})

    return rows.groupBy("shard").applyInPandas(run, "node long, other long, links long")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches (id, set, n, sig) and, for each distinct set: node, set, least (id), n_copies, n_links and root."""
    sketch = stored(sketches(docs, id_col, text_col), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("row")
    classes = sketch.groupBy("set").agg(least, F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = stored(classes.select("set", F.col("row.id").alias("least"), F.col("row.text_hash").alias("text_hash"), "n_copies", "n", "sig", F.monotonically_increasing_id().alias("node")), "nodes")
    dealt = _dealt(stored(_buckets(nodes), "buckets"), BUCKET_BLOCK, own=False)
    near = components(_connected(dealt.join(nodes.select("node", "sig"), "node")))
    members = stored(near.join(nodes.select("node", "least", "text_hash", F.col("n").alias("size")), "node"), "members")
    # A component's blocks are bounded in members and in shingles.
    sizes = members.groupBy("root").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") * F.lit(VERIFY_BLOCK / BLOCK_SHINGLES)).cast("long")).alias("n"))
    held = _rows_of(docs, members.select("node", F.col("least").alias("id"), "text_hash"), id_col, text_col)
    parts = members.join(sizes, "root").select(F.col("root").alias("key"), "n", "node")
    groups = _dealt(parts, VERIFY_BLOCK, own=True).join(stored(held, "texts"), "node")
    checked = stored(_verified(groups), "checked")
    links = checked.where("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(checked.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    out = nodes.select("node", "set", "least", "text_hash", "n_copies").join(roots, "node", "left").join(links, "node", "left")
    return sketch, out.withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, class_id, n_links, n_copies of every row of `docs`.

    class_id is the least id of all documents that chains of links reach; n_links is the number of different texts (by
    shingle set) of similarity 0.8 or more, each text once however often it is copied; n_copies is the number of rows
    with the same shingle set, itself included. Texts of fewer than five words are one shingle; texts without words
    (null and empty ones among them) are copies of each other and link to nothing. Rows with null ids take part; a
    class of such rows only has a null class_id. Repeated rows give repeated results, an empty table none.
    """
    sketch, by_node = _classes(docs, id_col, text_col)
    class_ids = by_node.groupBy("root").agg(F.min("least").alias("class_id"))
    by_set = by_node.join(class_ids, "root").select("set", "class_id", "n_links", "n_copies")
    return sketch.select("id", "set").join(by_set, "set").select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that stay when one document of each class of similar() does: that of the
    least id (of rows that repeat an id and a text, any one), one without id only if all are. An empty table gives an
    empty result."""
    _, by_node = _classes(docs, id_col, text_col)
    first = by_node.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node", "text_hash")).alias("m"))
    chosen = first.select(F.col("m.node").alias("node"), F.col("m.least").alias("id"), F.col("m.text_hash").alias("text_hash"))
    return _rows_of(docs, chosen, id_col, text_col, docs.columns).select(*docs.columns)


def _rows_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """For each row of `chosen` (node, id, text_hash) one row of `docs` with that id and text: node and text as UTF-8, or the
    columns in `keep`. Both sides are dealt by id and text: which rows are chosen grows with the table, so none is
    broadcast. Of rows that repeat both, each task sends one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text")
    key = (F.col(id_col).alias("_id"), _text_hash(text_col).alias("_hash"), F.xxhash64(F.col(id_col), _text_hash(text_col)).alias("_key"))
    own = docs.select(*key, text) if keep is None else docs.select(*key, F.struct(*keep).alias("_row"))
    own = own.mapInArrow(_once, own.schema)
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))
    met = own.join(chosen.select(F.col("node").alias("_node"), "id", "text_hash").hint("merge"), same).dropDuplicates(["_node"])
    return met.select("_row.*") if keep else met.select(F.col("_node").alias("node"), F.col("_text").alias("text"))


def _once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without those whose third column a row of the same task had before (of a bounded number of rows)."""
    seen: set[int] = set()
    for batch in it:
        keys = batch.column(2).to_pylist()
        if len(seen) > 1_000_000:
            seen.clear()
        new = []
        for k in keys:
            new.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(new, pa.bool_()))
