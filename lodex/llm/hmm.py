"""A hidden Markov language model over word classes, and an add-one unigram model beside it.

Tokens are words and one end mark a text. The most frequent tokens are classes of their own, the others fall into
classes by ending and length; a token's probability is its class's under the hidden state times its add-one share of
the class. Token counts are aggregated over the whole training part. States are trained by Baum-Welch: the training
part is dealt into steps of growing size, each step's expected counts are summed over its partitions and mixed with
those before (every training text is used once). A text's likelihood is exact: the forward recursion, scaled at each
token, over the whole text; many texts advance together, one token a step.

For scoring, texts are dealt into blocks. A block asks for the counts of its distinct tokens, one row each, and is joined
with the answer, so neither the vocabulary nor a token's occurrences are ever gathered in one place.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodex.llm.common import shared_dir, stored

#: Hidden states; tokens with classes of their own; classes of the others.
STATES, TOP, OTHERS = 8, 4000, 1024
CLASSES = TOP + OTHERS
#: 64ths of the training part in each Baum-Welch step.
STEPS = (1, 1, 1, 1, 2, 4, 6, 16, 32)
#: Tokens of texts that advance together, and of a block, about.
TOGETHER, BLOCK = 600_000, 1_500_000
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased, split at ASCII white space; then the end mark. Null is as empty."""
    return [*(text.lower().split() if text else ()), END]


class Coder(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def token_hash(word: bytes) -> int:
    """64 signed bits; tokens are told apart by them."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def ending(word: bytes) -> int:
    """The class of a less frequent word: by its last three bytes and its length."""
    return zlib.crc32(word[-3:] + bytes([min(15, len(word)) // 3])) % OTHERS


def count_tokens(train: DataFrame, text_col: str) -> DataFrame:
    """h, ending and n of every distinct token."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(map(token_hash, n), pa.int64()), pa.array(map(ending, n), pa.int32()), pa.array(n.values(), pa.int64())], names=["h", "ending", "n"])

        for batch in it:
            for text in batch.column(0).to_pylist():
                n.update(tokens(text))
            if len(n) > 1_000_000:
                yield out()
                n.clear()
        yield out()

    return train.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "h long, ending int, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Model:
    """Counts' totals, the frequent tokens (sorted hashes), the other classes' totals, and the hidden Markov model."""

    total: int
    distinct: int
    top: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # classes by states

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and classes of distinct words."""
        h = np.fromiter(map(token_hash, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.top, h), max(0, len(self.top) - 1))
        frequent = self.top[at] == h if len(self.top) else np.zeros(len(h), bool)
        return h, np.where(frequent, at, TOP + np.fromiter(map(ending, words), np.int64, len(words)))

    def within(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of the tokens' shares of their classes: add-one, with room for one unseen token."""
        other = np.maximum(classes - TOP, 0)
        return np.where(classes < TOP, 0.0, np.log10((n + 1) / (self.class_n[other] + self.class_v[other] + 1)))


class Together:
    """Sequences of classes, longest first, laid out token by token: at step t the first live[t] sequences go on."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.classes = np.empty(len(row), np.int64)
        self.classes[self.at[step] + row] = np.concatenate([sequences[i] for i in self.order])

    def forward(self, m: Model, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """log10 likelihood of each sequence, and (if kept) the scaled forward values and the scales."""
        e = m.emits[self.classes]
        logs = np.zeros(self.live[0])
        kept = np.empty_like(e) if keep else None
        scales = np.empty(len(e)) if keep else None
        a = None
        for t, n in enumerate(self.live):
            at = self.at[t]
            a = e[at : at + n] * (m.start if a is None else a[:n] @ m.moves)
            s = a.sum(axis=1)
            a /= s[:, None]
            logs[:n] += np.log10(s)
            if keep:
                kept[at : at + n], scales[at : at + n] = a, s
        out = np.empty_like(logs)
        out[self.order] = logs
        return out, kept, scales

    def expected(self, m: Model) -> np.ndarray:
        """Baum-Welch counts of starts, moves and emissions, as one vector."""
        _, a, s = self.forward(m, keep=True)
        e = m.emits[self.classes] / s[:, None]
        moves = np.zeros((STATES, STATES))
        back = np.ones((0, STATES))
        gamma = a  # becomes the posterior in place
        for t in range(len(self.live) - 1, -1, -1):
            n, at = self.live[t], self.at[t]
            b = np.ones((n, STATES))
            if len(back):
                w = e[self.at[t + 1] : self.at[t + 1] + len(back)] * back
                moves += a[at : at + len(back)].T @ w
                b[: len(back)] = w @ m.moves.T
            gamma[at : at + n] *= b
            back = b
        emits = np.stack([np.bincount(self.classes, gamma[:, k], CLASSES) for k in range(STATES)], axis=1)
        return np.concatenate([gamma[: self.live[0]].sum(axis=0), (moves * m.moves).ravel(), emits.ravel()])


def together(sequences: list[np.ndarray], most: int = TOGETHER) -> Iterator[tuple[int, Together]]:
    """The sequences in runs of about `most` tokens, each with the place of its first."""
    first, n = 0, 0
    for i, s in enumerate(sequences):
        n += len(s)
        if n >= most or i == len(sequences) - 1:
            yield first, Together(sequences[first : i + 1])
            first, n = i + 1, 0


def train(docs: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """A model of the texts for which `keep` holds, and the table of token counts (h, ending, n)."""
    part = docs.where(keep)
    spark = docs.sparkSession
    counts = stored(count_tokens(part, text_col), "counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = np.sort(np.array([r.h for r in counts.orderBy(F.desc("n"), "h").limit(TOP).select("h").collect()], np.int64))
    first = counts.orderBy(F.desc("n"), "h").limit(TOP).select("h", F.lit(True).alias("frequent"))
    rest = counts.join(F.broadcast(first), "h", "left").groupBy("frequent", F.when(F.col("frequent"), F.col("h")).alias("own"), F.when(F.col("frequent").isNull(), F.col("ending")).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row for each class
    share, class_n, class_v = np.ones(CLASSES), np.zeros(OTHERS), np.zeros(OTHERS)
    for r in rest:
        if r.frequent:
            share[np.searchsorted(top, r.own)] += r.n
        else:
            share[TOP + r.ending] += r.n
            class_n[r.ending], class_v[r.ending] = r.n, r.v
    share /= share.sum()
    noise = np.random.default_rng(7).normal(0, 0.6, (CLASSES, STATES))
    emits = share[:, None] * np.exp(noise)
    moves = np.full((STATES, STATES), 0.02 / STATES) + 0.98 * np.eye(STATES)
    model = Model(totals.n or 0, totals.v, top, class_n, class_v, np.full(STATES, 1 / STATES), moves, emits / emits.sum(axis=0))
    if not totals.n:
        return model, counts
    steps = F.lit(0)
    for at in np.cumsum(STEPS)[:-1]:
        steps = steps + (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(64)) >= int(at)).cast("int")
    path = _sequences(part.select(steps.alias("step"), F.col(text_col).cast("string").cast("binary").alias("text")), model)
    total = None
    for k in range(len(STEPS)):
        seen = _expected(spark.read.schema("seq binary, step int").parquet(path).where(F.col("step") == k).select("seq"), model)
        if not seen.any():
            continue
        total = seen if total is None else seen + 0.5 * total
        start, moved, emitted = total[:STATES], total[STATES : STATES + STATES**2].reshape(STATES, STATES), total[STATES + STATES**2 :].reshape(CLASSES, STATES)
        model.start = (start + 0.5) / (start + 0.5).sum()
        moved = moved + 0.1 + 0.9 * np.eye(STATES)
        model.moves = moved / moved.sum(axis=1, keepdims=True)
        emitted = emitted + 200 * share[:, None]
        model.emits = emitted / emitted.sum(axis=0)
    return model, counts


def _sequences(part: DataFrame, model: Model) -> str:
    """Writes the texts as class numbers (16 bits a token) by step; returns the folder."""
    shared = part.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        table = np.zeros(0, np.uint16)
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                own = batch.slice(at, 1000)
                if len(coder) > 1_000_000:
                    coder, table = Coder(), np.zeros(0, np.uint16)
                codes = [np.fromiter(map(coder.__getitem__, t), np.int64, len(t)) for t in map(tokens, own.column(1).to_pylist())]
                new = list(coder)[len(table) :] if len(coder) > len(table) else []
                table = np.concatenate([table, shared.value.classes(new)[1].astype(np.uint16)])
                yield pa.RecordBatch.from_arrays([pa.array([table[c].tobytes() for c in codes], pa.binary()), own.column(0)], names=["seq", "step"])

    out = f"{shared_dir(part.sparkSession)}/lodex-sequences-{np.random.default_rng().integers(1 << 62):x}"
    part.mapInArrow(run, "seq binary, step int").write.partitionBy("step").parquet(out)
    return out


def _expected(rows: DataFrame, model: Model) -> np.ndarray:
    """Baum-Welch counts of the sequences, summed over partitions: as many numbers as the model has."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = STATES + STATES**2 + CLASSES * STATES

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some, held, n = np.zeros(size), False, [], 0
        for batch in it:
            for s in batch.column(0).to_pylist():
                held.append(np.frombuffer(s, np.uint16))
                n += len(held[-1])
                if n >= TOGETHER:
                    total += Together(held).expected(shared.value)
                    some, held, n = True, [], 0
        if held:
            total += Together(held).expected(shared.value)
        if held or some:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "v"])

    out = np.zeros(size)
    got = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score (log10) of every row of `docs`.

    Null texts are as empty ones: the end mark alone. Repeated rows give repeated results, an empty table none. Without
    training texts every token is unseen.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    blocks = max(1, math.ceil(model.total * 7 / 6 / BLOCK), docs.count() // 20_000)
    # By the row's place, too, so that neither an id nor a text that many rows have makes a block large.
    block = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = docs.select(block.alias("block"), F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).repartition(blocks, "block")

    def asked(rows: pa.Table) -> pa.Table:
        found: set[bytes] = {END}
        for text in rows.column("text").to_pylist():
            found.update(tokens(text))
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()] * len(found), pa.int32()), "h": pa.array(map(token_hash, found), pa.int64())})

    known = dealt.groupBy("block").applyInArrow(asked, "block int, h long").join(counts.select("h", "n"), "h")

    def scored(rows: pa.Table, answer: pa.Table) -> pa.Table:
        m, coder = shared.value, Coder()
        codes = [np.fromiter(map(coder.__getitem__, t), np.int64, len(t)) for t in map(tokens, rows.column("text").to_pylist())]
        h, classes = m.classes(list(coder))
        keys = answer.column("h").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], answer.column("n").to_numpy()[order]
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        c = np.where(keys[at] == h, n[at], 0) if len(keys) else np.zeros(len(h), np.int64)
        base = np.log10((c + 1) / (m.total + m.distinct + 1))
        within = m.within(classes, c)
        hidden = np.zeros(len(codes))
        for first, run in together([classes[x] for x in codes]):
            logs = run.forward(m)[0]
            hidden[first : first + len(logs)] = logs
        total = lambda v: [float(v[x].sum()) for x in codes]
        return pa.table({"id": rows.column("id"), "n_tokens": pa.array([len(x) for x in codes], pa.int64()), "n_known": pa.array([int(np.count_nonzero(c[x])) for x in codes], pa.int64()), "base_score": pa.array(total(base), pa.float64()), "score": pa.array(hidden + np.array(total(within)), pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
