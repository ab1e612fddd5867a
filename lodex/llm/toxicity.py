"""Toxicity: misspelled lexicon terms found by Levenshtein automata, weighed by the words around them.

The lexicon is learned from labelled documents: words of significantly many toxic documents, after different words and
in both halves of the sample, that hardly occur in clean ones but for quotations. A word of a text is matched by running
its Levenshtein automaton (rows of edit distances, cut where no term below can still be within its bound) through the trie
of the lexicon; many words walk the trie together. How far from a term a misspelling may lie is learned, too: clean
documents must be as rarely near the term as they may have it. Each hit gets a context score: quotation marks or
reporting words around it make it a quotation, words of address make it abuse. A logistic model over the weighed hits,
fitted on the same labelled documents, gives the score; no hit can lower it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodex.llm.common import SEPARATORS, batches, fold, others, stored

#: Labelled documents to fit on, at most. All else that fitting holds is bounded by their number.
FIT_ROWS = 20_000
#: A term's share of toxic documents is this many times that of clean ones, at least; and the share of terms that may be
#: words without a bearing on the label.
RATIO, FALSE = 20, 0.05
#: Words on either side of a hit that its context score reads.
WINDOW = 6
#: What a misspelled hit counts for, of an exact one.
SPELLING = 0.7
#: Words that a worker remembers, and documents whose new words walk the trie together.
REMEMBERED, TOGETHER = 400_000, 500
_KEEP_MARK = bytes.maketrans(SEPARATORS.replace(b"\x01", b""), b" " * (len(SEPARATORS) - 1))
# Marks that open or close a quotation, and words of reporting and of address in the four languages.
QUOTES = '"“”„«»‹›「」'
REPORTING = frozenset("said says quote quoted wrote called word term dit écrit mot cité sagte schrieb wort zitat dijo dice escribió palabra".split())
ADDRESS = frozenset("you your yourself u ur tu toi vous du dich ihr sie usted eres ustedes".split())
MARK = "\x01"


def marked_words(text: str) -> list[str]:
    """Lower-cased words (letters and digits; other ASCII characters part them), and MARK for each quotation mark."""
    parts = text.lower()
    for q in QUOTES:
        if q in parts:
            parts = parts.replace(q, f" {MARK} ")
    return parts.encode("utf-8", "replace").translate(_KEEP_MARK).decode().split()


def context(marked: list[str], i: int, inside: bool) -> float:
    """1 for abuse, towards 0 for a quotation: what the words around the i-th say, and whether a quotation is open there."""
    around = marked[max(0, i - WINDOW) : i + WINDOW + 1]
    quoted = 1.0 * (inside and MARK in marked[i + 1 : i + 40]) + 0.5 * (not REPORTING.isdisjoint(around))
    return 1 / (1 + 3 * max(0.0, quoted - 0.5 * (not ADDRESS.isdisjoint(around))))


def contexts(marked: list[str]) -> Iterator[tuple[str, float]]:
    """Each word with its context."""
    near = {k for i, w in enumerate(marked) if w in REPORTING for k in range(i - WINDOW, i + WINDOW + 1)}
    inside = False
    for i, w in enumerate(marked):
        if w == MARK:
            inside = not inside
        else:
            yield w, context(marked, i, inside) if inside or i in near else 1.0


def allowed(length: int) -> int:
    """Edits by which a misspelling of a term of this length may differ, at most."""
    return 0 if length < 4 else 1 if length < 9 else 2


class Trie:
    """Terms, each with its bound, as nodes; a node knows the lengths and the largest bound of the terms below it."""

    def __init__(self, bounds: dict[str, int]):
        self.terms = sorted(bounds)
        self.bounds = [bounds[t] for t in self.terms]
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.below: list[tuple[int, int, int]] = [(1 << 30, 0, 0)]
        for k, t in enumerate(self.terms):
            node = 0
            for c in [*map(ord, t), None]:
                lo, hi, reach = self.below[node]
                self.below[node] = (min(lo, len(t)), max(hi, len(t)), max(reach, self.bounds[k]))
                if c is None:
                    self.ends[node] = k
                elif c in self.children[node]:
                    node = self.children[node][c]
                else:
                    self.children[node][c] = node = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.below.append((1 << 30, 0, 0))

    def pairs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words and terms within the term's bound: the word's and the term's number, and the distance.

        Words of equal length go together: a row of edit distances for each, from which a child's rows follow. A word
        leaves a branch once its row, with the letters that are left on either side, exceeds the largest bound below.
        """
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        for length, numbers in by_length.items():
            own = np.array(numbers)
            letters = np.frombuffer("".join(words[i] for i in numbers).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), length)
            steps = np.arange(length + 1, dtype=np.int32)
            stack = [(0, 0, own, letters, np.broadcast_to(steps, (len(own), length + 1)))]
            while stack:
                node, depth, who, text, row = stack.pop()
                if self.ends[node] is not None:
                    k = self.ends[node]
                    at = np.flatnonzero(row[:, -1] <= self.bounds[k])
                    if len(at):
                        found.append((who[at], k, row[at, -1]))
                for c, child in self.children[node].items():
                    lo, hi, reach = self.below[child]
                    if not lo - reach <= length <= hi + reach:
                        continue
                    new = np.empty_like(row, subok=False)
                    new[:, 0] = row[:, 0] + 1
                    np.minimum(row[:, 1:] + 1, row[:, :-1] + (text != c), out=new[:, 1:])
                    new = np.minimum.accumulate(new - steps, axis=1) + steps
                    left = length - steps
                    more = np.maximum(0, np.maximum(left - (hi - depth - 1), (lo - depth - 1) - left))
                    alive = np.flatnonzero((new + more).min(axis=1) <= reach)
                    if len(alive):
                        stack.append((child, depth + 1, who[alive], text[alive], new[alive]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate([w for w, _, _ in found]), np.concatenate([np.full(len(w), k) for w, k, _ in found]), np.concatenate([d for _, _, d in found])

    def nearest(self, words: list[str]) -> dict[str, tuple[str, int]]:
        """The nearest term (of equally near ones the first by order) and its distance for each word within a term's bound."""
        word, term, d = self.pairs(words)
        order = np.lexsort((term, d, word))
        first = order[np.concatenate([[True], np.diff(word[order]) > 0])] if len(order) else order
        return {words[word[i]]: (self.terms[term[i]], int(d[i])) for i in first}


@dataclass
class Model:
    """The lexicon (each term's weight and the edits that a misspelling may have), words near a term that clean documents
    have, and the weights of the logistic model."""

    terms: dict[str, float] = field(default_factory=dict)
    bounds: dict[str, int] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 3.0, 0.5]))

    def __post_init__(self):
        self.trie = Trie({t: self.bounds.get(t, allowed(len(t))) for t in self.terms})
        self.seen: set[str] = set()
        self.known: dict[str, tuple[str, int]] = {}

    def learn(self, words: set[str]) -> None:
        """Matches the words that aren't known yet."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.known = set(), {}
        new = words - self.seen
        self.seen |= new
        self.known |= self.trie.nearest([w for w in new if w in self.terms or w not in self.clean])

    def hits(self, text: str) -> list[tuple[str, str, int, float]]:
        """Word, term, distance and context weight (1 abuse, towards 0 quotation) of each hit."""
        marked = marked_words(text)
        self.learn(set(marked))
        return self._hits(marked)

    def _hits(self, marked: list[str]) -> list[tuple[str, str, int, float]]:
        if self.known.keys().isdisjoint(marked):
            return []
        out, inside = [], False
        for i, w in enumerate(marked):
            if w == MARK:
                inside = not inside
            elif w in self.known:
                out.append((w, *self.known[w], context(marked, i, inside)))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: a constant, and the logarithms of all weighed hits (misspelled ones for SPELLING of an
        exact one) and of distinct terms."""
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1.0
        for at in range(0, len(texts), TOGETHER):
            found = [marked_words(t or "") for t in texts[at : at + TOGETHER]]
            self.learn(set().union(*found))
            for i, marked in enumerate(found, at):
                if hits := self._hits(marked):
                    out[i, 1] = math.log1p(sum(self.terms[t] * c * (SPELLING if d else 1.0) for _, t, d, c in hits))
                    out[i, 2] = math.log1p(len({t for _, t, _, _ in hits}))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, keep, most: int) -> DataFrame:
    """id, text and label of at most `most` labelled documents that `keep` holds for, chosen by a hash of the id."""
    ids = labels.where(keep & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")  # `most` rows at most


def second_half():
    return F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)) == 1


def word_statistics(sample: DataFrame) -> DataFrame:
    """Of each word in the sample: t1, t2 (toxic documents of the first and second half with it), contexts (distinct words
    that it follows in toxic ones), c1, c2 (clean documents) and cw (the same, each by the word's context there).

    Copies of one document repeat its words after the same words; a term must stand in different places.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n: Counter = Counter()
            weighed: Counter = Counter()
            for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half")), strict=True):
                marked = marked_words(text)
                if label == 1:
                    found = [w for w in marked if w != MARK]
                    n.update({(w, p, 1, half) for p, w in zip(["", *found], found, strict=False)})
                    n.update({(w, None, 1, half) for w in found})
                    continue
                most: dict[str, float] = {}
                for w, v in contexts(marked):
                    most[w] = max(v, most.get(w, 0.0))
                for w, v in most.items():
                    n[w, None, 0, half] += 1
                    weighed[w, None, 0, half] += v
            cols = list(zip(*n, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(n.values(), pa.int64()), pa.array([float(weighed[k]) for k in n], pa.float64())], names=["word", "before", "label", "half", "n", "weighed"])

    rows = sample.dropDuplicates(["text", "label"]).select("text", "label", second_half().cast("int").alias("half")).mapInArrow(count, "word string, before string, label int, half int, n long, weighed double")
    pairs = rows.groupBy("word", "before", "label", "half").agg(F.sum("n").alias("n"), F.sum("weighed").alias("weighed"))
    docs = lambda label, half: F.coalesce(F.sum(F.when(F.col("before").isNull() & (F.col("label") == label) & (F.col("half") == half), F.col("n"))), F.lit(0))
    return pairs.groupBy("word").agg(docs(1, 0).alias("t1"), docs(1, 1).alias("t2"), F.count_distinct("before").alias("contexts"), docs(0, 0).alias("c1"), docs(0, 1).alias("c2"), F.round(F.sum("weighed"), 6).alias("cw"))


def learn_lexicon(sample: DataFrame) -> tuple[Model, frozenset[str]]:
    """Lexicon, bounds and clean words from a bounded sample of (id, text, label), and the clean words of its first half.

    A clean document counts against a term by the word's context there, so one that quotes it counts less. A word's
    chance is that of its support (documents, or contexts if fewer) among all its documents under the sample's share of
    toxic ones, by Chernoff's bound; the words of the k least chances are terms for the largest k with which they are
    at most FALSE * k / words (Benjamini and Hochberg). A word of clean documents is never taken for a misspelling. How often words that aren't known yet look like one is seen in the second half under
    the clean words of the first: a term's bound is the largest by which clean documents come RATIO times as rarely near
    it as toxic ones have it.
    """
    stats = stored(word_statistics(sample), "words")  # read three times
    total = {(r.label, r.half): r.n for r in sample.dropDuplicates(["text", "label"]).groupBy("label", second_half().cast("int").alias("half")).agg(F.count("*").alias("n")).collect()}
    toxic, clean, clean2 = sum(n for (k, _), n in total.items() if k == 1), sum(n for (k, _), n in total.items() if k != 1), sum(n for (k, h), n in total.items() if k != 1 and h)
    if not toxic or not clean:
        return Model(), frozenset()
    t, share = F.col("t1") + F.col("t2"), toxic / (toxic + clean)
    support = F.least(t, F.col("contexts")).cast("double")
    of = support + F.col("cw")
    part = support / of
    gain = support * F.log(part / share) + F.when(F.col("cw") > 0, F.col("cw") * F.log((1 - part) / (1 - share))).otherwise(0.0)
    tried = stats.where(t > 0).count()
    chosen = stats.where((F.col("t1") > 0) & (F.col("t2") > 0) & (t * clean >= RATIO * F.col("cw") * toxic)).where((part > share) & (gain >= -math.log(FALSE)))
    chosen = chosen.select("word", t.alias("t"), "contexts", "cw", F.round(gain, 9).alias("gain")).orderBy(F.desc("gain"), "word").collect()  # of a bounded sample
    least = [k for k, r in enumerate(chosen, 1) if r.gain >= math.log(tried / (FALSE * k))]
    chosen = [r for r in chosen if least and r.gain >= chosen[least[-1] - 1].gain]
    odds = {r.word: math.log((r.t + 0.1) / (toxic + 1)) - math.log((r.cw + 0.1) / (clean + 1)) for r in chosen}
    terms = {r.word: min(3.0, 0.5 * odds[r.word]) * min(1.0, r.contexts / 8) for r in chosen}
    trie = sample.sparkSession.sparkContext.broadcast(Trie({w: allowed(len(w)) for w in terms}))

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = batch.column(0).to_pylist()
            w, k, d = trie.value.pairs(found)
            yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in w], pa.string()), pa.array([trie.value.terms[i] for i in k], pa.string()), pa.array(d.astype(np.int32)), batch.column(1).take(pa.array(w)), batch.column(2).take(pa.array(w))], names=["word", "term", "d", "c1", "c2"])

    close = stats.where("c1 + c2 > 0").select("word", "c1", "c2").mapInArrow(near, "word string, term string, d int, c1 long, c2 long").where("d > 0").collect()  # words near terms, of a bounded sample
    false: Counter = Counter()
    for r in close:
        if not r.c1 and r.word not in terms:
            false[r.term, r.d] += r.c2
    bounds = {}
    for r in chosen:
        fits = [sum(false[r.word, i] for i in range(1, d + 1)) * RATIO * toxic <= r.t * max(1, clean2) for d in range(1, allowed(len(r.word)) + 1)]
        bounds[r.word] = (fits + [False]).index(False)
    held = {r.word: bool(r.c1) for r in close if r.d <= bounds[r.term] and r.word not in terms}
    return Model(terms, bounds, frozenset(held)), frozenset(w for w, first in held.items() if first)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep=None, fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most `fit_rows` labelled documents for which `keep` (a condition on the labels) holds.

    Without labelled documents of both classes the model has no lexicon and gives every text the same low score.
    Several labels of an id count as the highest; labels of unknown ids, null labels and null ids are left out.
    """
    sample = stored(labelled(docs, labels, label, id_col, text_col, F.lit(True) if keep is None else keep, fit_rows), "sample")
    model, first_half = learn_lexicon(sample)
    shared = sample.sparkSession.sparkContext.broadcast(Model(model.terms, model.bounds, first_half))

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array(list(shared.value.features(batch.column("text").to_pylist())), pa.list_(pa.float64())), batch.column("label")], names=["f", "label"])

    part = sample.where((F.col("label") == 1) | second_half()).select("text", "label")
    rows = part.mapInArrow(features, "f array<double>, label int").groupBy("f", "label").count().collect()  # of a bounded sample
    if len({r.label for r in rows}) == 2:
        x, y, n = (np.array([r[k] for r in rows], float) for k in ("f", "label", "count"))
        n = np.where(y == 0, 2 * n, n)  # half of the clean documents stands for all
        model.weights = _logistic(x, y, n)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic model, those of hits not negative: the first column is the constant, a column whose weight
    would be negative is left out."""
    used = list(range(x.shape[1]))
    while True:
        own = x[:, used]
        w, pull = np.zeros(len(used)), np.diag([1e-6, *[0.05] * (len(used) - 1)])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            w = w + np.linalg.solve((own * (n * p * (1 - p))[:, None]).T @ own + pull, own.T @ (n * (y - p)) - pull @ w)
        if (w[1:] >= 0).all():
            break
        used.remove(used[1 + int(np.argmin(w[1:]))])
    out = np.zeros(x.shape[1])
    out[used] = w
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `docs` (or those in `keep`) and toxicity (0 to 1). Null and empty texts score as texts without
    hits; repeated rows have equal scores; an empty table gives an empty result. Columns named like the added one, in
    letters of either case, are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in others(docs, "toxicity") if keep is None or f.name in keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            scores = shared.value.score(batch.column(text_col).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "toxicity"])

    return docs.select(*dict.fromkeys([*(f.name for f in fields), text_col])).mapInArrow(run, T.StructType([*fields, T.StructField("toxicity", T.DoubleType())]))


def train_fold(id_col: str = "doc_id"):
    """The labels that may be learned from."""
    return fold(id_col, 3) != 1
