"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its mean and covariance of the statistics, summed over partitions. A covariance is shrunk towards the
pooled one and that towards its diagonal; its Cholesky factor is computed once. A text's score is the logistic of the
difference of the two log densities (Mahalanobis distances and log determinants) and the log prior odds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodex.llm.common import batches, others
from lodex.llm.toxicity import labelled

#: Labelled documents to fit on, at most.
FIT_ROWS = 50_000
# Shares of the pooled covariance in a class's, and of the diagonal in the pooled one; the ridge is in units of variance.
POOL, DIAGONAL, RIDGE = 0.15, 0.05, 1e-3
NAMES = ("length", "words", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "bang", "bars", "line_length", "short_lines", "repeated_lines", "repeated_words", "repeated_pairs", "top_word", "sentences", "entropy", "empty")

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"!?", b"|", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _i
_SUMS = np.zeros((256, 8))
_SUMS[np.arange(256), _CLASS] = 1.0


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics of a text's UTF-8 bytes, in the order of NAMES; null is as empty."""
    if not text:
        return np.array([0.0] * (len(NAMES) - 1) + [1.0])
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, marks, symbols, bang, bars, _ = (counts @ _SUMS)[1:] / n
    letters = counts[97:123].sum() + counts[128:].sum() + counts[65:91].sum()
    found = text.split()
    m = max(1, len(found))
    sizes = np.fromiter(map(len, found), np.int64, len(found)) if found else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    words = Counter(found)
    pairs = len(set(zip(found, found[1:], strict=False))) if m > 1 else 1
    p = counts[counts > 0] / n
    top = max(words.values()) if m > 1 else 0
    logit = lambda x: np.log((x + 1e-3) / (1 - x + 1e-3))
    return np.array([
        np.log1p(n), np.log1p(len(found)), np.log1p(sizes.mean()), np.log1p(sizes.std()), logit(min(1.0, counts[65:91].sum() / max(1, letters))), logit(digits), logit(marks), logit(symbols), logit(bang), logit(bars),
        np.log1p(n / len(lines)), logit(sum(len(x) < 30 for x in lines) / len(lines)), logit(1 - len(set(lines)) / len(lines)), logit(1 - len(words) / m), logit(1 - min(1.0, pairs / max(1, m - 1))), logit(top / m), logit(min(1.0, counts[46] / m)), float(-(p * np.log(p)).sum()), 0.0,
    ])


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants of the classes 0 and 1, log prior odds, and the scale of the
    difference of log densities (statistics aren't independent normals, so the raw difference is too sure)."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_prior: float
    scale: tuple[float, float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.difference(x) + b, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep=None, fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most `fit_rows` labelled documents for which `keep` holds; rows as in toxicity.labelled().

    With documents of one class only, or none, every text scores that class's smoothed share.
    """
    d = len(NAMES)
    sample = labelled(docs, labels, label, id_col, text_col, F.lit(True) if keep is None else keep, fit_rows)

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per class: number, sums and sums of products of one partition."""
        total = np.zeros((2, 1 + d + d * d))
        for batch in it:
            x = np.array([statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, d)
            y = np.array(batch.column("label").to_pylist(), int)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["label", "sums"])

    sums = sample.mapInArrow(moments, "label int, sums array<double>").select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) numbers
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r.label, r["at"]] = r.v
    n = total[:, 0]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), prior, (0.0, prior))
    means = total[:, 1 : 1 + d] / n[:, None]
    scatter = total[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / max(1.0, n.sum() - 2)
    pooled = (1 - DIAGONAL) * pooled + (DIAGONAL + RIDGE) * np.diag(np.diag(pooled) + 1e-4)
    factors, dets = [], []
    for c in (0, 1):
        share = POOL + (1 - POOL) * d / (n[c] + d)  # few rows lean on the pooled covariance
        lower = np.linalg.cholesky((1 - share) * scatter[c] / max(1.0, n[c] - 1) + share * pooled)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    model = Model(means, np.stack(factors), np.array(dets), prior, (1.0, prior))
    model.scale = _scale(sample, model)
    return model


def _scale(sample: DataFrame, model: Model) -> tuple[float, float]:
    """Slope and offset that make the differences of log densities of the fitted rows probabilities."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def differences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.difference(x) if len(x) else [], pa.float64()), batch.column("label")], names=["x", "label"])

    rows = sample.mapInArrow(differences, "x double, label int").collect()  # of a bounded sample
    x, y = np.clip(np.array([r.x for r in rows]), -50, 50), np.array([r.label for r in rows], float)
    w, pull = np.array([0.3, 0.0]), np.diag([1e-3, 1e-3])
    for _ in range(40):
        z = np.stack([x, np.ones_like(x)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `docs` (or those in `keep`) and quality (0 to 1, higher: label 1 likelier). Null texts score as
    empty ones; repeated rows have equal scores; an empty table gives an empty result. Columns named like the added one,
    in letters of either case, are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in others(docs, "quality") if keep is None or f.name in keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            x = np.array([statistics(t) for t in batch.column(text_col).cast(pa.binary()).to_pylist()]).reshape(-1, len(NAMES))
            scores = shared.value.score(x) if len(x) else []
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "quality"])

    return docs.select(*dict.fromkeys([*(f.name for f in fields), text_col])).mapInArrow(run, T.StructType([*fields, T.StructField("quality", T.DoubleType())]))
