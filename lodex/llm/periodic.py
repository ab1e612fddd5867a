"""Periodic runs of words, found by a dictionary of basic factors.

For each power of two L, every stretch of L words that occurs again in its text has a number, made of the numbers of its two
halves. Where three successive occurrences of a stretch form an arithmetic progression whose step d is at most twice L, d is
proposed as a period. In a run of smallest period q the next occurrence of a stretch of L >= q words is q words on, at each
place of the run, so a run of four periods or more shows at the L with L / 2 < q <= L as one unbroken row of progressions
of step q, and no multiple of q is ever proposed in it. Rows are extended word by word to their ends and deduplicated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodex.llm.common import fold, others, texts

#: Words whose factors are named together.
BLOCK_WORDS = 300_000
#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def proposals(names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the arithmetic progressions, for each power-of-two length. `names` numbers the words; equal
    words of different texts have different numbers, so that no factor across texts occurs twice."""
    n, length = len(names), 1
    at = np.arange(n)
    while True:
        order = np.argsort(names[at], kind="stable")
        place, own = at[order], names[at[order]]
        same = own[1:] == own[:-1]
        step = np.where(same, np.diff(place), 0)  # to the successor
        thrice = (step[1:] == step[:-1]) & (step[1:] > length // 2) & (step[1:] <= length)
        yield place[:-2][thrice], step[:-1][thrice]
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])  # what occurs once ends here
        group = np.cumsum(np.concatenate([[True], ~same]))[again]
        at = place[again]
        number = np.full(n, -1)
        number[at] = group
        at = np.sort(at)
        at = at[at + length < n]
        at = at[number[at + length] >= 0]
        if not len(at):
            return
        names = np.full(n, -1)
        names[at] = number[at] * (group[-1] + 1) + number[at + length]
        length *= 2


def runs_of(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period. `words` numbers the words of one or more texts,
    one after the other, and `text` says whose each is, rising."""
    n = len(words)
    found = [np.zeros((2, 0), np.int64)]
    found += [np.stack(p) for p in proposals(np.unique(text * (words.max() + 1) + words, return_inverse=True)[1])] if n else []
    place, period = np.concatenate(found, axis=1)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.concatenate([[True], (np.diff(period) != 0) | (np.diff(place) != 1)]) if len(place) else np.zeros(0, bool)
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(place) - 1]]) if len(place) else np.zeros(0, int)
    a, b, q = place[new], place[last] + 3 * period[last], period[new]  # a row's words: each of its progressions spans three periods
    agree = lambda x, y: (text[x] == text[y]) & (words[x] == words[y])
    while len(grow := np.flatnonzero(a > 0)) and len(grow := grow[agree(a[grow] - 1, a[grow] - 1 + q[grow])]):
        a[grow] -= 1
    while len(grow := np.flatnonzero(b < n)) and len(grow := grow[agree(b[grow], b[grow] - q[grow])]):
        b[grow] += 1
    runs = np.unique(np.stack([a, b - a, q], axis=1), axis=0)
    runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, collapse: bool = True) -> DataFrame:
    """The columns of `docs` (or those of `keep`), n_words, runs (start, length, period in words, from 0, by start and then
    period) and, if asked for, collapsed: the words joined by one blank, without those that a run contains behind its first
    period.

    Words are what the white space of ASCII parts. A null or empty text has no words; repeated rows have equal results; an
    empty table gives an empty result. Columns named like the added ones, in letters of either case, are replaced. One pass
    without a shuffle: a task names the factors of a block of texts, or of one longer text, at a time.
    """
    kept = [f for f in others(docs, "n_words", "runs", "collapsed") if keep is None or f.name in keep]

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            split = [t.split() if t else [] for t in texts(batch, "_text")]
            for a, b in word_blocks([len(w) for w in split]):
                counts = np.array([len(w) for w in split[a:b]])
                starts = np.concatenate([[0], np.cumsum(counts)])
                numbers: dict[bytes, int] = {}
                words = np.fromiter((numbers.setdefault(w, len(numbers)) for own in split[a:b] for w in own), np.int64, starts[-1])
                found = runs_of(words, np.repeat(np.arange(b - a), counts))
                owner = np.searchsorted(starts, found[:, 0], "right") - 1
                ends = np.searchsorted(owner, np.arange(b - a + 1))
                found[:, 0] -= starts[owner]
                cols = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], names=["start", "length", "period"])
                cols += [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)]
                if collapse:
                    cols.append(pa.array([b" ".join(collapsed(w, found[ends[i] : ends[i + 1]])) for i, w in enumerate(split[a:b])], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "n_words", "runs", *["collapsed"] * collapse])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words bigint", f"runs {RUN}", *["collapsed string"] * collapse])
    return docs.select(*(F.col(f.name) for f in kept), F.col(text_col).cast("string").alias("_text")).mapInArrow(find, schema)


def word_blocks(counts: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of together BLOCK_WORDS words, or of one longer text."""
    a, n = 0, 0
    for i, c in enumerate(counts):
        if i > a and n + c > BLOCK_WORDS:
            yield a, i
            a, n = i, 0
        n += c
    if counts:
        yield a, len(counts)


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not len(found):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return [w for w, k in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not k]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_runs, start, length, period, exponent_milli of the run of greatest length / period (of equal ones the
    first, then that of the least period; null without runs), and digests: runs_sha256 of all runs, collapsed_sha256 of the
    collapsed text. One pass over the rows that runs() gives."""
    found = runs(docs, text_col, [id_col])
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        none = sha(b"")
        for batch in it:
            own, best = batch.column(1).to_pylist(), []
            for rs in own:
                x = max(rs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])) if rs else None
                best.append((x["start"], x["length"], x["period"], 1000 * x["length"] // x["period"]) if x else (None,) * 4)
            listed = [sha("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in rs).encode()) if rs else none for rs in own]
            cols = [batch.column(0), pa.array(map(len, own), pa.int64()), *(pa.array(c, pa.int64()) for c in (zip(*best, strict=True) if best else [()] * 4))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(listed, pa.string()), pa.array([sha(t) for t in texts(batch, "collapsed")], pa.string())], names=["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    rows = found.select(F.col(id_col).alias("id"), "runs", "collapsed")
    out = rows.mapInArrow(digest, f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
    return out.withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and text, in a tenth of the documents (by crc32 of the id as text, h) with a run from word a on: word i becomes
    word a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8), in whole numbers, of g = h / 10 and n words.
    All other texts are as they are."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.concat(F.slice(ws, F.lit(1), a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(ws, a + i % p)))

    once = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.array_join(repeated(ws), " "))), 1)  # the words are parted once
    return docs.select(id_col, F.when(fold(id_col, 10) == 0, F.coalesce(once, F.col(text_col))).otherwise(F.col(text_col)).alias("text"))
