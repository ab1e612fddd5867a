"""Benchmark decontamination: which words of a document lie in a passage of a benchmark item.

A passage is a window of `window` consecutive item words (an item of fewer words is one window). A document
contains a window exactly if its words occur there in order, so it must contain the window's rarest word: that
word is the window's prefix under the order by rarity. Rarity is the number of documents with the word, counted
over the whole table. Where a prefix word occurs, its place in the window gives the only possible start
(positional bound), the window must fit into the document (length bound), and the words are then compared. The
benchmark's windows are made by Spark and held in blocks of a bounded number, one pass over the documents each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodex.llm.common import stored, texts, words

#: Benchmark windows that one pass over the documents may hold in memory (about 150 bytes each); a larger benchmark takes
#: more passes. And windows of a piece: a longer item is cut, so that it can lie in several passes.
BLOCK_WINDOWS, PIECE = 300_000, 2000


def windows_of(found: list[bytes], window: int) -> list[list[bytes]]:
    """All windows of an item: `window` consecutive words, or all if there are fewer."""
    n = min(window, len(found))
    return [found[i : i + n] for i in range(len(found) - n + 1)] if found else []


def pieces_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item, text (words parted by spaces) and n (its windows): the items in pieces of PIECE windows at most."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                found = words(text)
                n = max(1, len(found) - window + 1)
                rows += [(item, b" ".join(found[a : a + PIECE + window - 1]), min(PIECE, n - a)) for a in range(0, n if found else 0, PIECE)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["item", "text", "n"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    return rows.mapInArrow(cut, "item string, text binary, n long").distinct()


def blocks_of(pieces: DataFrame, block_windows: int) -> Iterator[tuple[pa.Table, bool]]:
    """The pieces in blocks of about `block_windows` windows, dealt by item and text (so that neither copies of a text nor
    a long item make a block larger), and whether a block is the last."""
    pieces = stored(pieces, "windows")
    n = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_windows))
    for k in range(n):
        yield pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).select("item", "text").toArrow(), k == n - 1  # one block


def held_windows(block: pa.Table, window: int) -> dict[bytes, tuple]:
    """The items of each window in a block; windows of the same items share them."""
    items: dict[bytes, list] = {}
    for item, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
        for w in windows_of(text.split(), window):
            own = items.setdefault(b" ".join(w), [])
            if not own or own[-1] != item:
                own.append(item)
    shared: dict[tuple, tuple] = {}
    return {w: shared.setdefault(t, t) for w, t in ((w, tuple(dict.fromkeys(own))) for w, own in items.items())}


def document_counts(docs: DataFrame, text_col: str, wanted: set[bytes]) -> Counter:
    """In how many documents each of the wanted words occurs; `wanted` is bounded by the block."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in it:
            for text in texts(batch, text_col):
                n.update(shared.value.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

    rows = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({bytes(r.word): r.n for r in rows.toLocalIterator()})


def contained(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """All columns of `docs` (or those in `keep`) but those it adds: n_words, spans (merged word ranges that lie in benchmark windows, end
    exclusive) and items (distinct ids, as sorted strings, of the items with windows there).

    Null and empty texts have no words, and no item without words is ever found. Items with equal text or repeated ids
    count once each by id; a null id gives spans but is not listed. Repeated document rows each get their own result; an
    empty table gives an empty result. Columns of `docs` named like the added ones are replaced.
    """
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
    out = docs.drop(*added.names)
    plain, kept = out.schema.fields, [f for f in out.schema.fields if keep is None or f.name in keep]
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(added["spans"].dataType), "items": F.lit(None).cast(added["items"].dataType)})
    for block, last in blocks_of(pieces_of(benchmark, item_col, item_text_col, window), block_windows):
        held = held_windows(block, window)
        split = {w: w.split() for w in held}
        rarity = document_counts(docs, text_col, {x for ws in split.values() for x in ws}) if held else Counter()
        prefixes: dict[bytes, set[tuple[int, int]]] = {}
        for ws in split.values():
            _, _, at = min((rarity[x], x, i) for i, x in enumerate(ws))
            prefixes.setdefault(ws[at], set()).add((at, len(ws)))
        shared = docs.sparkSession.sparkContext.broadcast((held, {k: sorted(v) for k, v in prefixes.items()}))  # one block
        schema = T.StructType([*(kept if last else plain), *added.fields])
        out = out.mapInArrow(_scan(shared, text_col, added, schema.names), schema)
        if not last:
            out = stored(out, "contained")  # so that a task holds one block at a time
    return out


def _scan(shared, text_col: str, added: T.StructType, names: list[str]):
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in added.fields}

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, prefixes = shared.value
        for batch in it:
            new: dict[str, list] = {"n_words": [], "spans": [], "items": []}
            for text, spans, items in zip(texts(batch, text_col), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                found = words(text)
                ranges, ids = [(s["start"], s["end"]) for s in spans or ()], set(items or ())
                for i in [i for i, w in enumerate(found) if w in prefixes]:
                    for at, n in prefixes[found[i]]:
                        start = i - at
                        if start >= 0 and start + n <= len(found) and (own := held.get(b" ".join(found[start : start + n]))) is not None:
                            ranges.append((start, start + n))
                            ids.update(own)
                merged: list[list[int]] = []
                for a, b in sorted(ranges):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                new["n_words"].append(len(found))
                new["spans"].append([{"start": a, "end": b} for a, b in merged])
                new["items"].append(sorted(ids - {None}))
            yield pa.RecordBatch.from_arrays([pa.array(new[n], kinds[n]) if n in new else batch.column(n) for n in names], names=names)

    return scan


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of contained(): counts, the items' hash and whether anything was hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
