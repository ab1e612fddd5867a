"""What the text operators share: table access, shared-folder tables, words and folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodex.sources.shared import shared_dir, stored

__all__ = ["HashCache", "batches", "fold", "mixed", "others", "shared_dir", "shingles", "stored", "table", "texts", "word_hashes", "words"]

#: ASCII bytes that end a word: everything but digits, letters and the bytes of non-ASCII characters.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *added: str) -> list[T.StructField]:
    """The fields of `df` but those named like a column to add, in letters of either case, as Spark tells them apart."""
    return [f for f in df.schema.fields if f.name.lower() not in {a.lower() for a in added}]


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, split at ASCII characters other than letters and digits. Null has none."""
    return text.lower().translate(_TO_SPACE).split() if text else []


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


class HashCache(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(cache: HashCache, found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct sorted 64-bit hashes of `n` consecutive words; fewer words make one shingle, none make none."""
    k = min(n, len(hashes))
    if not k:
        return np.zeros(0, np.uint64)
    m = len(hashes) - k + 1
    total = np.full(m, k, np.uint64)
    for i in range(k):
        total = mixed(total + hashes[i : i + m])
    return np.unique(total)


def batches(it: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows`."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
