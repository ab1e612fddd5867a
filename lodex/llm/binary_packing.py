"""Packing by powers of two: each document's token ids are cut into pieces whose lengths are those of its length's binary
digits, and pieces of equal length share a bucket. A piece is a sequence by itself, so no sequence crosses documents and
none is padded.

A document of n tokens gives n // most pieces of the largest length and then one for each binary digit of what is left,
longest first. Training draws batches of one bucket at a time (`batches`), all sequences of a batch being equally long.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodex.llm.common import others, stored
from lodex.sources.shared import scratch

#: Characters of text whose pieces make one batch of rows.
BLOCK_CHARS = 4_000_000
#: A blank before anything but white space: the tokenizer always begins a part there, and no part before it minds what follows.
CUT = re.compile(r" (?=\S)")
#: How the tokenizer parts a text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteIds:
    """Little-endian 32-bit ids of texts, as a byte-level tokenizer's file says.

    Where the vocabulary's ids are in the order of its merges, the same merges run over ranks, which takes a quarter of the
    time; only characters below U+3000 go that way, as white space, letters and digits are the same for both there. A text
    with others is cut at blanks in front of characters that aren't white space, where the tokenizer always begins a part,
    and those chunks that have them go to the tokenizer, as does a whole text with the string of a special token.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(Path(path).read_text())
        self.special = [t["content"] for t in told["added_tokens"]]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {level.pre_tokenize_str(chr(b))[0][0][-1]: b for b in range(0xC0)}  # a character's last byte is below 0xC0
        first = sorted(set(level.alphabet()) - set(letters))  # the other bytes' letters are in their order
        letters |= dict(zip(first, range(0xC0, 0x100), strict=True))
        vocabulary = told["model"]["vocab"]
        ids = [vocabulary.get(m.replace(" ", "") if isinstance(m, str) else "".join(m), -1) for m in told["model"]["merges"]]
        plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.ranked = None
        if plain and ids == sorted(set(ids)) and ids[:1] > [255]:
            ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if self.ranked is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if low(text):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        first, *rest = CUT.split(text)
        same = groupby([first, *(" " + c for c in rest)], low)
        encode = {True: self.ranked.encode_ordinary, False: lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids}
        return b"".join(array("I", encode[k]("".join(chunks))).tobytes() for k, chunks in same)


def low(text: str) -> bool:
    return text.isascii() or max(text) < "\u3000"


_known: dict[str, ByteIds] = {}


def binary_lengths(n: int, most: int) -> list[int]:
    """Powers of two, falling, at most `most`, whose sum is n."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def decompose(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows `id_col`, start, length, ids_crc32, doc_tokens, bucket (log2 of the length) and, if asked for, ids (little-endian
    unsigned 32-bit).

    A document's ids are those of its whole text and then `end_id`; `most` is a power of two. A null or empty text has the
    end id alone; repeated rows give repeated pieces, null ids pieces with a null id; an empty table gives an empty result.
    Further columns are left out. `tokenizer` is the path of a byte-level tokenizer's file. One pass without a shuffle; a
    task holds a block of texts and their ids.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the largest length must be a power of two")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _known.get(tokenizer) or _known.setdefault(tokenizer, ByteIds(tokenizer))
        end = end_id.to_bytes(4, "little")
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, BLOCK_CHARS):
                cols: list[list] = [[] for _ in range(7)]
                for doc, text in zip(batch.column(0)[a:b].to_pylist(), texts[a:b], strict=True):
                    data = ids.of(text) + end
                    n, at = len(data) // 4, 0
                    for size in binary_lengths(n, most):
                        piece = data[4 * at : 4 * (at + size)]
                        for col, v in zip(cols, (doc, at, size, zlib.crc32(piece), n, size.bit_length() - 1, piece), strict=True):
                            col.append(v)
                        at += size
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                k = 7 if with_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds[:k], strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"][:k])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)


def blocks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of together `most` characters, or of one longer text."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if i > a and n + len(t) > most:
            yield a, i
            a, n = i, 0
        n += len(t)
    if texts:
        yield a, len(texts)


def sequences(pieces: DataFrame) -> DataFrame:
    """All columns of `pieces`, sequence_id and offset (0): each piece is a sequence. Ids of a bucket's sequences lie
    together, longer ones behind shorter ones. Columns named like the added ones, in letters of either case, are replaced."""
    names = [f.name for f in others(pieces, "sequence_id", "offset")]
    number = F.shiftleft(F.col("bucket").cast("long"), 58) + F.monotonically_increasing_id()  # below 2^58 for 2^25 partitions
    return pieces.select(*names, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def batches(packed: DataFrame, tokens: int = 1 << 16, seed: int = 0) -> DataFrame:
    """All columns of a table of sequences, batch and place: batches of together `tokens` tokens, all of one bucket (its last
    one may have fewer), their sequences drawn in an order that `seed` sets. batch counts from 0 in each bucket.

    The sequences are ranged by bucket and hash and stored; a row's number is its place in its part of the ranges plus what
    the parts before have of its bucket, so no task sees more than its part. `tokens` is at least the longest sequence. Columns
    named like the added ones are replaced.
    """
    names = [f.name for f in others(packed, "batch", "place", "_part", "_own")]
    drawn = packed.select(*names, F.xxhash64("sequence_id", F.lit(seed)).alias("_own"))
    placed = stored(drawn.repartitionByRange("bucket", "_own").withColumn("_part", F.spark_partition_id()), "drawn")
    counts = placed.groupBy("bucket", "_part").agg(F.count("*").alias("_n"))  # a row for each part, and some more
    before = counts.select("bucket", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy("_own", "sequence_id")) - 1
    row, size = F.col("_before") + F.col("_row"), F.greatest(F.lit(1).cast("long"), F.expr(f"shiftright({tokens}L, bucket)"))
    return placed.withColumn("_row", own).join(before, ["bucket", "_part"]).select(*names, F.floor(row / size).alias("batch"), (row % size).alias("place"))


def write_buckets(packed: DataFrame, path: str | None = None) -> str:
    """Writes a folder of Parquet files for each length, so that a reader of one length reads nothing else; returns the path."""
    path = path or scratch(packed.sparkSession, "buckets")
    packed.write.partitionBy("bucket").parquet(path)
    return path
