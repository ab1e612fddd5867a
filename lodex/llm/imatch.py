"""I-Match fingerprints: hashes of a text's distinct terms within several random subsets of a lexicon.

The lexicon holds the terms whose share of documents lies in a band, that is, whose inverse document frequency lies in
one. The lower share also bounds its size: the shares of all terms add up to the mean number of distinct terms of a
document, so at most that number divided by the lower share can reach it, however large the table is. Subsets keep each
lexicon term with the chance of their level (a hash of term and subset decides, so no subset is ever stored); a
subset's hash sums the hashes of its distinct terms in the text, which is the same for any order of them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodex.llm.common import HashCache, batches, mixed, others, stored, words

#: The band: shares of documents that a lexicon term may occur in.
LEAST, MOST = 2e-4, 0.02
#: Chances of the levels and how many subsets each has; the first is the whole lexicon.
LEVELS = ((1.0, 1), (1 / 4, 16), (1 / 16, 16), (1 / 64, 16), (1 / 256, 16))
#: A text with fewer lexicon terms is fingerprinted by all its terms.
FEW = 4
#: Documents that a range of ids has: at least about, and at most about where there are more ranges than shuffle partitions.
RANGE_ROWS, MOST_RANGE_ROWS = 4000, 50_000
#: Rows that the ranges' beginnings are chosen from, at most about, and terms whose subsets are looked up together.
SAMPLED, TOGETHER = 2_000_000, 200_000

_KEEP = np.concatenate([np.full(n, min(p * 2.0**64, 2.0**64 - 2048), np.float64) for p, n in LEVELS]).astype(np.uint64)
_SEEDS = mixed(np.arange(1, len(_KEEP) + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_LEVEL = np.concatenate([np.full(n, i) for i, (_, n) in enumerate(LEVELS)])


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted 64-bit hashes of the terms that at least a share `least` and at most a share `most` of the documents
    have (in small tables, any term of up to one document in fifty, and always those of a single document)."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, n, rows = HashCache(), Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(cache.__getitem__, n), np.uint64, len(n)).view(np.int64)), pa.array(np.fromiter(n.values(), np.int64, len(n)))], names=["term", "n"])

        for batch in it:
            for text in batch.column(0).to_pylist():
                rows += 1
                n.update(set(words(text)))
            if len(n) > 1_000_000:
                yield out()
                n.clear()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], names=["term", "n"])

    df = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = stored(df, "terms")  # read twice
    total = df.where("term is null").select(F.col("n").alias("total"))  # one row
    band = df.where("term is not null").crossJoin(F.broadcast(total)).where(F.col("n").between(least * F.col("total"), F.greatest(most * F.col("total"), F.lit(1.0))))
    terms = band.select("term").toArrow().column(0).to_numpy().view(np.uint64)
    return np.sort(terms)


def memberships(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which subsets keep each term: where the term's part of the other two arrays begins, subsets, and hashes there."""
    term, subset, value = [], [], []
    for k in range(len(_KEEP)):
        m = mixed(terms ^ _SEEDS[k])
        chosen = np.flatnonzero(m <= _KEEP[k])
        term.append(chosen)
        subset.append(np.full(len(chosen), k))
        value.append((mixed(m[chosen]) >> np.uint64(34)).astype(np.float64))  # 30 bits: sums of 2^23 terms are exact
    at = np.concatenate(term)
    order = np.argsort(at, kind="stable")
    return np.searchsorted(at[order], np.arange(len(terms) + 1)), np.concatenate(subset)[order], np.concatenate(value)[order]


def fingerprints(texts: list[list[bytes]], terms: np.ndarray, cache: HashCache) -> np.ndarray:
    """A row of 16-bit subset hashes for each list of words; 0 stands for a subset without terms of the text."""
    hashes = [np.fromiter(map(cache.__getitem__, s), np.uint64, len(s)) for s in map(set, texts)]
    out, first, n = np.zeros((len(texts), len(_KEEP)), np.uint16), 0, 0
    for i, h in enumerate(hashes, 1):  # runs of texts that bound the memory
        n += len(h)
        if n >= TOGETHER or i == len(hashes):
            out[first:i] = _prints(hashes[first:i], terms)
            first, n = i, 0
    return out


def _prints(hashes: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    flat, row = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), list(map(len, hashes)))
    if not len(flat):
        return np.zeros((len(hashes), len(_KEEP)), np.uint16)
    at = np.minimum(np.searchsorted(terms, flat), max(0, len(terms) - 1))
    inside = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
    few = np.bincount(row[inside], minlength=len(hashes)) < FEW
    inside |= few[row]
    distinct, code = np.unique(flat[inside], return_inverse=True)
    begin, subset, value = memberships(distinct)
    sizes = begin[code + 1] - begin[code]
    place = np.repeat(begin[code] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    cell = np.repeat(row[inside] * len(_KEEP), sizes) + subset[place]
    total = np.bincount(cell, value[place], minlength=len(hashes) * len(_KEEP)).reshape(-1, len(_KEEP))
    some = np.bincount(cell, minlength=total.size).reshape(total.shape) > 0
    h = (mixed(total.astype(np.uint64) + _SEEDS) >> np.uint64(48)).astype(np.uint16)
    return np.where(some, np.maximum(h, 1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprint rows: the share of subsets with equal hashes, at the level where it is largest.

    A subset that neither text has terms of says nothing. Sparse levels, where few subsets have terms, count as having
    six. Two texts without terms are alike.
    """
    union, equal = (a > 0) | (b > 0), (a == b) & (a > 0)
    best = np.where((a == b).all(axis=1), 1.0, 0.0)
    for k, (_, n) in enumerate(LEVELS):
        if k:
            own = _LEVEL == k
            best = np.maximum(best, equal[:, own].sum(axis=1) / np.maximum(union[:, own].sum(axis=1), 6))
    return best


def written(prints: np.ndarray) -> list[str]:
    """Fingerprint rows as text: four hexadecimal digits a subset."""
    whole, n = prints.astype(">u2").tobytes().hex(), 4 * prints.shape[1]
    return [whole[i * n : (i + 1) * n] for i in range(len(prints))]


def fingerprint(docs: DataFrame, text_col: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """The columns of `docs` and fingerprint. Null texts are as empty ones, whose fingerprint has only zeros; repeated
    rows have equal fingerprints; an empty table gives an empty result. A column named like the added one, in letters of
    either case, is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col) if terms is None else terms)
    fields = others(docs, "fingerprint")
    kept = [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches(it, 500):
            texts = batch.column(text_col).cast(pa.string()).cast(pa.binary()).to_pylist()
            prints = written(fingerprints([words(t) for t in texts], shared.value, cache))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints, pa.string())], names=[*kept, "fingerprint"])

    return docs.select(*kept).mapInArrow(run, T.StructType([*fields, T.StructField("fingerprint", T.StringType())]))


class Ranges:
    """Ranges of rows by (id, tie): where each but the first begins. A beginning that comes several times is one of
    many equal rows, which are spread over all ranges that begin with them."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray):
        self.keys = np.rec.fromarrays([ids, ties], names="id,tie")

    def of(self, ids: np.ndarray, ties: np.ndarray, first: int) -> np.ndarray:
        """The rows' ranges; `first` is the place of the first row, by which equal rows are spread."""
        own = self.keys.id
        out, end = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
        for i in np.flatnonzero(end > out):
            same = self.keys.tie[out[i] : end[i]]
            low, high = (int(np.searchsorted(same, ties[i], side)) for side in ("left", "right"))
            out[i] += high if high - low < 2 else low + 1 + (first + i) % (high - low)
        return out


def ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """`docs` (id, tie, text) in ranges by id and tie, each one partition, with the first row of the next range (own is
    false there), and the first row of all.

    What the driver holds is a beginning for each range (as for any range partitioning) and a bounded sample to find them.
    """
    spark, keys = docs.sparkSession, docs.select("id", "tie")
    rows = docs.count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(round(rows / RANGE_ROWS), max(least, round(rows / MOST_RANGE_ROWS))))
    every = max(1, rows // min(100 * n, SAMPLED))
    some = keys.where(F.pmod(F.xxhash64("id", "tie", F.monotonically_increasing_id()), F.lit(every)) == 0).toArrow()  # about SAMPLED rows at most
    ids, ties = (some.column(c).to_numpy() for c in ("id", "tie"))
    order = np.lexsort((ties, ids))[[i * len(ids) // n for i in range(1, n)] if len(ids) else []]
    shared = spark.sparkContext.broadcast(Ranges(ids[order], ties[order]))

    def numbered(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        first = 0
        for batch in it:
            yield batch, shared.value.of(batch.column(0).to_numpy(), batch.column(1).to_numpy(), first)
            first += batch.num_rows

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in numbered(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32))], names=["id", "tie", "part"])

    heads = keys.mapInArrow(parts, "id long, tie long, part int").groupBy("part").agg(F.min(F.struct("id", "tie")).alias("head")).orderBy("part").collect()  # one row a range
    if not heads:
        return docs.withColumns({"part": F.lit(0), "own": F.lit(True)}), None
    before: dict[tuple[int, int], list[int]] = {}
    for r, last in zip(heads[1:], heads, strict=False):
        before.setdefault(tuple(r["head"]), []).append(last.part)
    to = spark.sparkContext.broadcast((before, np.array(sorted({i for i, _ in before}), np.int64)))

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        names = ["id", "tie", "text", "part", "own"]
        for batch, part in numbered(it):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array(np.ones(len(part), bool))], names=names)
            links, ids = to.value
            rows = np.flatnonzero(np.isin(batch.column(0).to_numpy(), ids))
            again = [(i, p) for i in rows.tolist() for p in links.get((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), ()) if p not in sent]
            for i, p in again:  # of equal rows, one a task is enough
                if p not in sent:
                    sent.add(p)
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([p], pa.int32()), pa.array([False])], names=names)

    out = docs.select("id", "tie", "text").mapInArrow(placed, "id long, tie long, text string, part int, own boolean")
    head = heads[0]["head"]
    return out.repartitionById(n, "part").sortWithinPartitions("part", F.desc("own"), "id", "tie"), docs.where((F.col("id") == head.id) & (F.col("tie") == head.tie)).limit(1)


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text's last quarter is the head of the next document's text, by id (after the last: the first's). Null
    texts are as empty ones. Rows of equal ids follow each other by a hash of the text; null ids come first. One text
    alone is its own next. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("tie"), "text")
    shared = spark.sparkContext.broadcast(lexicon(given, "text") if terms is None else terms)
    placed, head = ranges(given)
    start = spark.sparkContext.broadcast(head.first()["text"] if head is not None else "")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()

        def out(rows: list[tuple[int, str]], following: str) -> pa.RecordBatch:
            own = [t for _, t in rows]
            after = [*own[1:], following]
            cut = [len(t) // 4 for t in own]
            edited = [(t[: len(t) - k] + n[:k]).encode() for t, n, k in zip(own, after, cut, strict=True)]
            prints = fingerprints([*(words(t.encode()) for t in [*own, following]), *map(words, edited)], shared.value, cache)
            a, b = prints[: len(own) + 1], prints[len(own) + 1 :]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            cols = ([i if i != least else None for i, _ in rows], list(map(len, own)), [hashlib.sha256(t).hexdigest() for t in edited], written(a[:-1]), written(b), likeness(a[:-1], b), likeness(a[:-1], a[1:]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        rows: list[tuple[int, str]] = []
        part, closed, held = None, None, 0
        for batch in it:
            for i, text, p, own in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "part", "own")), strict=True):
                if p != part:
                    if rows:
                        yield out(rows, closed if closed is not None else start.value)
                    rows, part, closed, held = [], p, None, 0
                if own:
                    if len(rows) >= 500 or held >= 2_000_000:
                        yield out(rows, text)
                        rows, held = [], 0
                    rows.append((i, text))
                    held += len(text)
                elif closed is None:
                    closed = text
        if rows:
            yield out(rows, closed if closed is not None else start.value)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.select("id", "text", "part", "own").mapInArrow(run, schema).withColumnRenamed("id", id_col)
