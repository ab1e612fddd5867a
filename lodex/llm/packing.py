"""Packing token sequences into bins of fixed capacity, with lower bounds that certify the bin counts.

Pieces as long as a bin are bins of their own and take no part. The others are dealt into groups of a bounded number
of bins; each group runs best-fit decreasing and compares its bin count with a lower bound from dual-feasible
functions (rounding functions under which no bin's items exceed one). Dual-feasible sums add up over groups, so the
same functions bound the whole table's count, too. While the table is not certified, groups whose last bins leave a gap
give those bins' documents away: they are dealt anew, together with those of other groups, into fewer groups, and
best-fit decreasing runs again. A group never uses more bins for given documents than before.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.common import others, stored

#: Bins and pieces that a group holds at most, on average; both bound a task's memory.
GROUP_BINS, GROUP_PIECES = 2048, 200_000
#: Chunks of text whose ids a worker remembers.
CACHED = 400_000

#: How the tokenizer parts a lower-case chunk without apostrophes: letters, single digits, anything else.
PARTS = re.compile(r"[^\W\d_]+|\d|(?:[^\w]|_)+")
#: Below U+0250, the characters that Python's \w counts in and that are neither letters nor decimal digits.
OTHER_NUMBERS = frozenset("²³¹¼½¾")


#: How the tokenizer parts a text of small letters below U+0250 (a fixed value), and the white space in it.
MARKS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\t-\r \x85\xa0]|_)+")
SPACES = r"\t-\r \x85\xa0"
#: Stretches without letters and blanks.
ODD = re.compile("[^ " + "".join(c for c in map(chr, range(0x250)) if c.isalpha()) + "]+")


def plain(word: str) -> bool:
    """What the tokenizer's clean-up leaves as it is, below U+0250."""
    return max(word) < "\u0250" and word.lower() == word and is_normalized("NFC", word)


class ChunkIds(dict):
    """Little-endian 32-bit ids of the chunks of text between spaces or line ends.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its chunks in order. A chunk
    of letters and a final stop or comma is two tokens' worth of words, and ASCII letters are lower-cased. A word of
    letters goes to the tokenizer's merges as it is, written in its alphabet of bytes; any other chunk takes the whole way.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        super().__init__({"": b""})
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.merge = self.tokenizer.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x80, 0x250)) if c.isalpha()}
        self.marks = {c: self.encode(c) for c in ".,"}
        self.ranked = self.ids = None
        self.odd: dict[str, str] = {}
        self._rank(path, level)

    def _rank(self, path: str, level) -> None:
        """The merges over ranks, where the vocabulary's words end in </w>. A word's end is a line end here, which no word
        has: the last byte takes it first, then all merges go in their order."""
        import tiktoken

        told = json.loads(Path(path).read_text())["model"]
        vocabulary, merges = told["vocab"], [m.split(" ") if isinstance(m, str) else m for m in told["merges"]]
        letters = {level.pre_tokenize_str(chr(b))[0][0][-1]: bytes([b]) for b in range(0xC0) if b != 10}  # a character's last byte is below 0xC0
        letters |= {level.pre_tokenize_str(chr((b & 31) << 6))[0][0][0]: bytes([b]) for b in range(0xC2, 0xCA)}  # the first bytes below U+0280
        spelled = lambda t: b"".join(letters[c] for c in t.removesuffix("</w>")) + b"\n" * t.endswith("</w>")
        if told.get("end_of_word_suffix") != "</w>":
            return
        ranks, ids = {bytes([b]): b for b in range(256)}, [0] * 256
        for t in (*letters, *(f"{c}</w>" for c in letters), *(a + b for a, b in merges)):
            if set(t.removesuffix("</w>")) <= set(letters):
                piece = spelled(t)
                if len(piece) == 1:
                    ids[piece[0]] = vocabulary[t]
                elif piece not in ranks:
                    ranks[piece] = len(ids)
                    ids.append(vocabulary[t])
        self.ranked = tiktoken.Encoding("ranked", pat_str=rf"[^{SPACES}]+\n", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array(ids, "<u4")
        self.ends = np.zeros(len(ids), bool)
        self.ends[[r for piece, r in ranks.items() if piece.endswith(b"\n")]] = True

    def text(self, text: str) -> bytes | None:
        """Ids of a whole text of characters below U+0250 without a special token's string; none for others."""
        if self.ranked is None or "<|" in text:
            return None
        low = text.lower()
        if not low.isascii() and (max(low) >= "\u0250" or max(text) >= "\u0250" or not is_normalized("NFC", text)):
            return None
        low = low.replace("\n", " ")
        marked = "\n".join(MARKS.findall(low)) if "'" in low else ODD.sub(self._odd, low).replace(" ", "\n ")
        ranks = self.ranked.encode_ordinary(marked + "\n")
        return self.ids[np.frombuffer(array("I", ranks), np.uint32)].tobytes()

    def _odd(self, m: re.Match) -> str:
        """A stretch without letters, its parts and the letters around it told apart by line ends."""
        known = self.odd.get(m[0])
        if known is None:
            if len(self.odd) > CACHED:
                self.odd.clear()
            known = self.odd[m[0]] = "\n" + "\n".join(MARKS.findall(m[0])) + "\n"
        return known

    def merged(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of small letters below U+0250, all at once."""
        ranks = np.array(self.ranked.encode_ordinary("".join(w + "\n" for w in words)), np.int64)
        data, at = self.ids[ranks].tobytes(), 0
        for end in (4 * np.flatnonzero(self.ends[ranks]) + 4).tolist():
            yield data[at:end]
            at = end

    def encode(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word or chunk that isn't known yet."""
        if word.isascii():
            if word.isalpha():
                return array("I", [t.id for t in self.merge(word)]).tobytes()
        elif plain(word) and OTHER_NUMBERS.isdisjoint(word):
            if word.isalpha():
                return array("I", [t.id for t in self.merge(word.translate(self.letters))]).tobytes()
        else:
            return self.encode(word)
        parts = PARTS.findall(word)
        if "'" in word or "<|" in word or len(parts) < 2:
            return self.encode(word)
        out = []
        for w in parts:
            ids = self.get(w)
            if ids is None:
                self[w] = ids = self.word(w)
            out.append(ids)
        return b"".join(out)

    def learn(self, chunks: set[str]) -> None:
        """Makes the ids of all chunks known."""
        if len(self) + len(chunks) > CACHED:
            self.clear()
            self[""] = b""
        parted = []
        for c in chunks.difference(self):
            end = c[-1]
            w = c[:-1] if end in ".," and c[:-1].isalpha() and "İ" not in c else c  # its small form ends in a mark
            parted.append((c, w.lower() if w.isascii() and "<|" not in w else w, "" if w is c else end))  # a special token's string is one in small letters only
        if self.ranked:
            words = [w for w in {w for _, w, _ in parted}.difference(self) if w.isalpha() and (w.isascii() or plain(w))]
            self.update(zip(words, self.merged(words), strict=True))
        for c, w, end in parted:
            ids = self.get(w)
            if ids is None:
                self[w] = ids = self.word(w)
            self[c] = ids + self.marks[end] if end else ids


_known: dict[tuple[str, bool], ChunkIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, special_as_text: bool = False) -> DataFrame:
    """Rows `id_col`, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit).

    A document's ids are those of its text and then `end_id`; only longer ones are cut, into pieces of `capacity`. A
    null or empty text has the end id alone; repeated rows give repeated pieces, null ids pieces with a null id; an empty
    table gives an empty result. Further columns are left out. `tokenizer` is a file's path. The string of a special token in a
    text is that token, as the tokenizer has it, or with `special_as_text` as any other text.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _known.get((tokenizer, special_as_text)) or _known.setdefault((tokenizer, special_as_text), ChunkIds(tokenizer, special_as_text))
        end = np.asarray([end_id], "<u4").tobytes()
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [ids.text(t or "") for t in batch.column(1).to_pylist()]
                chunks = {i: (batch.column(1)[i].as_py() or "").replace("\n", " ").split(" ") for i, data in enumerate(found) if data is None}
                ids.learn(set().union(*chunks.values()))
                rows: list[tuple] = []
                for i, (doc, data) in enumerate(zip(batch.column(0).to_pylist(), found, strict=True)):
                    data = (b"".join(map(ids.__getitem__, chunks[i])) if data is None else data) + end
                    for k, a in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[a : a + 4 * capacity]
                        rows.append((doc, k, a // 4, len(piece) // 4, zlib.crc32(piece), piece))
                cols = list(zip(*rows, strict=True))
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: each item's bin, numbered from 0."""
    room: list[tuple[int, int]] = []  # free space and bin, ascending
    bins, n = np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, n = capacity, n, n + 1
        bins[i] = b
        if free > size:
            insort(room, (free - size, b))
    return bins


def dual_feasible(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Sums over the items under each dual-feasible function; each sum is a lower bound of the number of bins.

    The functions are the identity, those that lift items over capacity - t to a bin and drop items below t, and those
    that round x to multiples of 1/k.
    """
    n = np.bincount(lengths, counts, minlength=capacity + 1) if len(lengths) else np.zeros(capacity + 1)
    x = np.arange(capacity + 1)
    tokens, items = np.cumsum(n * x), np.cumsum(n)
    t = np.arange(1, capacity // 2 + 1)
    lifted = (tokens[capacity - t] - tokens[t - 1]) / capacity + items[-1] - items[capacity - t]
    rounded = []
    for k in range(1, 21):
        even = (x * (k + 1)) % capacity == 0
        rounded.append((np.where(even, x / capacity, np.floor(x * (k + 1) / capacity) / k) * n).sum())
    return np.array([tokens[-1] / capacity, *lifted, *rounded])


def lower_bound(sums: np.ndarray) -> int:
    return math.ceil(float(sums.max()) - 1e-6)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", max_rounds: int = 12) -> DataFrame:
    """All columns of `pieces`, sequence_id and offset: the pieces of a sequence lie without gaps from 0 and take at most
    `capacity`.

    Lengths are from 1 to `capacity`, else the job fails; null lengths fail, too. Repeated rows are packed one by one.
    An empty table gives an empty result. Whether the number of sequences is the least is what certificate() tells: bins with
    at most a 512th free stay as they are, and after `max_rounds`, or where rounds no longer gain, so does the rest.
    Lengths come back as longs, all other columns as they were, whatever their names; columns named like the added ones, in letters of either case, are replaced.
    """
    kept = others(pieces, "sequence_id", "offset")
    names, size = [f"c{i}" for i in range(len(kept))], f"c{[f.name for f in kept].index(length_col)}"  # no name of a caller's meets ours
    length = F.col(size)
    given = pieces.select(*(F.col(f"`{f.name}`").alias(c) for f, c in zip(kept, names, strict=True)))
    fits = F.when((length >= 1) & (length <= capacity), length).otherwise(F.raise_error(F.lit("a piece's length isn't between 1 and the capacity")))
    pieces = stored(given.withColumn(size, fits.cast("long")), "pieces")
    whole = pieces.where(length == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    counts = pieces.where(length < capacity).groupBy(size).count().collect()  # at most `capacity` rows
    lengths, n = np.array([r[0] for r in counts], int), np.array([r[1] for r in counts], float)
    bound = lower_bound(dual_feasible(lengths, capacity, n))
    done, settled = [whole], 0
    seed, rest = F.xxhash64(*names, F.spark_partition_id(), F.monotonically_increasing_id()), pieces.where(length < capacity)
    rest = rest.withColumn("deal", seed).withColumn("bin", F.lit(None).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id long, offset long, open boolean"
    tokens, items, before = float((lengths * n).sum()), float(n.sum()), 1 << 62
    for k in range(max_rounds if items else 0):
        groups = max(1, math.ceil(tokens / (capacity * GROUP_BINS)), math.ceil(items / GROUP_PIECES))
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("deal", F.lit(k)), F.lit(groups)).cast("int"))
        out = stored(dealt.groupBy("group").applyInArrow(_pack_group(capacity, size, k), schema), f"packed-{k}")
        first = F.col("offset") == 0
        s = out.agg(F.count_if(first & ~F.col("open")).alias("shut"), F.count_if(first & F.col("open")).alias("open"), F.sum(F.when(F.col("open"), length)).alias("tokens"), F.count_if("open").alias("items")).first()
        settled += s.shut
        final = groups == 1 or not s.open or settled + s.open <= bound or (s.open >= before and k > 3)
        done.append((out if final else out.where("not open")).select(*names, "sequence_id", "offset"))
        if final or k == max_rounds - 1:
            if not final:
                done.append(out.where("open").select(*names, "sequence_id", "offset"))
            break
        rest = out.where("open").withColumn("bin", F.col("sequence_id")).drop("sequence_id", "offset", "open")
        tokens, items, before = float(s.tokens), float(s["items"]), s.open
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select(*(F.col(c).alias(f.name) for f, c in zip(kept, names, strict=True)), "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """One row: sequences of a packed table, bound (no packing of these pieces has fewer) and certified (they are equal)."""
    counts = packed.groupBy(F.col(length_col).alias("length")).agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("first")).collect()  # at most `capacity` rows
    bound = lower_bound(dual_feasible(np.array([r.length for r in counts], int), capacity, np.array([r.n for r in counts], float)))
    n = sum(r["first"] for r in counts)
    return packed.sparkSession.createDataFrame([(n, bound, n == bound)], "sequences long, bound long, certified boolean")


def _pack_group(capacity: int, size: str, k: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("group").sort_by("deal")
        lengths = rows[size].to_numpy().astype(np.int64)
        bins = best_fit(lengths, capacity)
        if k:  # where the documents came from fewer bins, those stay
            old = np.unique(rows["bin"].to_numpy(), return_inverse=True)[1]
            bins = old if old.max() < bins.max() else bins
        used = np.bincount(bins, lengths)
        sums = dual_feasible(lengths, capacity)
        gap = len(used) - float(sums.max())  # the part of a bin, or more, that the bound leaves open
        order = np.lexsort((np.arange(len(bins)), bins))
        starts = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        first = np.concatenate([[True], np.diff(bins[order]) > 0])
        offset = np.empty(len(bins), np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        open_bin = (capacity - used > capacity // 512) & (gap > 1e-6)
        added = {"sequence_id": (k << 56) + (key[0].as_py() << 24) + bins, "offset": offset, "open": open_bin[bins]}
        for name, values in added.items():
            rows = rows.append_column(name, pa.array(values))
        return rows

    return run
