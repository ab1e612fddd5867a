"""Secret scans: patterns over a text and over all that is encoded in it.

A worklist holds layers, each a text with, for every character, the range of the document it came from. Every layer is
scanned; what it encodes (URL escapes, Unicode escapes, base64, UTF-16, compressed bytes within those) becomes new layers until
none is new. Decoded bytes are scanned whatever they are, those that aren't UTF-8 as one character each; compressed data
may begin anywhere in them. What they unfold to is scanned in windows. Layers are remembered by text
and place, so one that decodes to itself ends there. Spans found in a layer are given as ranges of the document: a URL or
Unicode escape maps to itself, base64 to its groups of four characters, compressed data to the whole run that holds it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.common import others

KINDS = ("assign", "access", "hex")
# The patterns of the base and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the least length can stand in the pattern
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: The shortest secret has 12 characters, which are 16 of base64.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2})*")
#: Escapes of byte strings besides those; compressed bytes may need them, nothing else is looked for in such texts.
LITERAL = re.compile(UNICODE.pattern + r"""|\\[0abfnrtv'"\\]""")
LITERALS = {"0": "\0", "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
#: How compressed data begin; a byte that isn't UTF-8 is a lone surrogate or, by Unicode escapes, a code point.
MAGIC = re.compile("\x1f[\x8b\udc8b]\x08|x[\x01^\x9c\udc9c\xda\udcda\u0680-\u06bf]|BZh[1-9](?:1AY&SY|\x17rE8P[\x90\udc90])|[\xfd\udcfd]7zXZ\0|\\([\xb5\udcb5]/[\xfd\udcfd]")
#: The same in bytes, at the end of another member or frame, with padding before it and zstd's frames to skip.
NEXT = re.compile(rb"\0*(?=\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18)", re.S)
#: Characters of two bytes of which one is nothing, in either order, as UTF-16 has all of ASCII.
WIDE = re.compile(r"(?:[^\0]\0){11,}[^\0]?")
#: A place that no match, run or escape reaches over.
BREAK = re.compile(rb"\0\0|[\x01-\x08\x0b\x0c\x0e-\x1f!$(),<>?@\[\]^`|~*]|[\"'.:;{}%&#\\]\r?\n|\n[ \t\r]*\n")
#: Unfolded bytes that a window has at least and at most, and by how much windows without a break between them overlap. Only
#: where a single run, or data compressed again inside, is longer than MOST may something be missed (the row says so in `cut`).
PIECE, MOST, OVERLAP = 8 << 20, 64 << 20, 1 << 20


def matches(text: str) -> list[tuple[int, str, int]]:
    """start, kind, end of the base patterns: leftmost, not overlapping within a kind."""
    out: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


class Layer:
    """A text and the ranges of the document that its characters came from (None: the document itself)."""

    def __init__(self, text: str, at: np.ndarray | None = None, to: np.ndarray | None = None):
        self.text, self.at, self.to = text, at, to

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.at is None else (int(self.at[start:end].min()), int(self.to[start:end].max()))


def _replaced(layer: Layer, found: Iterator[re.Match], decode) -> Layer | None:
    """The layer with each match replaced by the characters that decode() gives, with their places in the match."""
    parts, at, to, last, changed = [], [], [], 0, False
    own = np.arange(len(layer.text))
    low = layer.at if layer.at is not None else own
    high = layer.to if layer.to is not None else own + 1
    for m in found:
        chars = decode(m)
        if chars is None:
            continue
        changed = True
        parts.append(layer.text[last : m.start()])
        at.append(low[last : m.start()])
        to.append(high[last : m.start()])
        for c, a, b in chars:
            parts.append(c)
            at.append(np.array([low[m.start() + a]]))
            to.append(np.array([high[m.start() + b - 1]]))
        last = m.end()
    if not changed:
        return None
    parts.append(layer.text[last:])
    return Layer("".join(parts), np.concatenate([*at, low[last:]]), np.concatenate([*to, high[last:]]))


def _url(m: re.Match) -> list[tuple[str, int, int]]:
    data, out, i = bytes.fromhex(m[0].replace("%", "")), [], 0
    while i < len(data):
        n = next((n for n in (1, 2, 3, 4) if _utf8(data[i : i + n]) is not None), 0)
        out.append((_utf8(data[i : i + n]) if n else _lax(data[i : i + 1]), 3 * i, 3 * (i + max(1, n))))
        i += max(1, n)
    return out


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _unicode(m: re.Match) -> list[tuple[str, int, int]] | None:
    s = m[0]
    if re.fullmatch(r"(?:\\u[0-9A-Fa-f]{4})+", s):
        units, out, i = [int(s[k + 2 : k + 6], 16) for k in range(0, len(s), 6)], [], 0
        while i < len(units):
            u, n = units[i], 1
            if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                u, n = 0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00, 2
            out.append(("�" if 0xD800 <= u < 0xE000 else chr(u), 6 * i, 6 * (i + n)))
            i += n
        return out
    u = int(re.sub(r"[^0-9]", "", s)) if re.fullmatch(r"&#[0-9]+;", s) else int(re.sub(r"^(?:\\u\{|\\U|\\x|&#[xX])|[};]$", "", s), 16)
    return None if u > 0x10FFFF or 0xD800 <= u < 0xE000 else [(chr(u), 0, len(s))]


def _literal(m: re.Match) -> list[tuple[str, int, int]] | None:
    return _unicode(m) if UNICODE.fullmatch(m[0]) else [(LITERALS.get(m[0][1], m[0][1]), 0, 2)]


class Unfolding:
    """What the compressed data at the head of `data` hold; members, streams or frames in a row are one."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.used, self.ended = data, 0, False

    def pieces(self) -> Iterator[bytes]:
        """Pieces of PIECE bytes at most. Data that end early or are damaged give what can be read of them."""
        while True:
            self.ended = False
            yield from self._member()
            if not self.ended:
                return
            while m := NEXT.match(self.data, self.used):
                if self.data[m.end() + 1 : m.end() + 4] != b"\x2a\x4d\x18":
                    break
                self.used = min(len(self.data), m.end() + 8 + int.from_bytes(self.data[m.end() + 4 : m.end() + 8], "little"))
            if not m:
                return
            self.used = m.end()

    def _member(self) -> Iterator[bytes]:
        head = self.data[self.used : self.used + 3]
        if head[:1] == b"\x28":
            # A zstd block of 4 bytes may hold 128 kB.
            d, step, feed = zstandard.ZstdDecompressor().decompressobj(), 256, lambda part: d.decompress(part)
        elif head == b"BZh" or head[:1] == b"\xfd":
            d, step = bz2.BZ2Decompressor() if head == b"BZh" else lzma.LZMADecompressor(), 1 << 16
            feed = lambda part: d.decompress(part, PIECE)
        else:
            d, step = zlib.decompressobj(47), 1 << 14
            feed = lambda part: d.decompress(d.unconsumed_tail + part, PIECE)
        while not d.eof and self.used < len(self.data):
            part = self.data[self.used : self.used + step]
            kept = d.copy() if isinstance(d, ZLIB) else None
            self.used += len(part)
            try:
                out = feed(part)
                while out:
                    yield out
                    out = b"" if d.eof or step == 256 else feed(b"") if kept is None and not d.needs_input or kept is not None and len(out) == PIECE else b""
            except ERRORS:
                d = kept
                for i in range(len(part) if kept is not None else 0):
                    try:
                        out = feed(part[i : i + 1])
                    except ERRORS:
                        break
                    if out:
                        yield out
                return
        if d.eof:
            self.used -= len(d.unused_data)
            self.ended = True


ZLIB = type(zlib.decompressobj())
ERRORS = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def _open(data: bytes) -> bool:
    """Whether data compressed within these bytes go on beyond them."""
    at = 0
    while m := START.search(data, at):
        inner = Unfolding(memoryview(data)[m.start() :])
        some = sum(map(len, inner.pieces()))
        if some and not inner.ended and m.start() + inner.used == len(data):
            return True
        at = m.start() + (inner.used if inner.ended else 1)
    return False


START = re.compile(NEXT.pattern[len(rb"\0*") :], re.S)


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """All pieces as windows that end at breaks, and whether one had to end elsewhere, where the next overlaps it."""
    held, enough = bytearray(), PIECE
    for piece in pieces:
        held += piece
        if len(held) < enough:
            continue
        place = None
        if not _open(bytes(held)):
            for tail in (1 << 12, 1 << 16, 1 << 20, len(held)):
                for m in BREAK.finditer(held, max(0, len(held) - tail)):
                    place = m.end()
                if place:
                    break
        if place:
            yield bytes(held[:place]), False
            held, enough = held[place:], PIECE
        elif len(held) >= MOST:
            yield bytes(held), True
            held, enough = held[-OVERLAP:], PIECE
        else:
            enough = min(MOST, len(held) + PIECE)
    if held:
        yield bytes(held), False


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and how many bytes each is in UTF-8, a lone surrogate for a byte being one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.where(points >> 8 == 0xDC, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))


def _unfolded(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """Windows of what the compressed data in a layer hold, each in the place of all data it comes from, and whether one is cut."""
    text, at, sizes = layer.text, 0, None
    while m := MAGIC.search(text, at):
        a = m.start()
        at = a + 1
        if sizes is None:
            points, sizes = _points(text)
            whole, first = text.encode("utf-8", "surrogateescape"), np.concatenate([[0], np.cumsum(sizes)])
            wide = np.append(np.flatnonzero(points >= 0x100), len(text))
        views = [(memoryview(whole)[first[a] :], True)]
        narrow = points[a : wide[np.searchsorted(wide, a)]].astype(np.uint8)
        if (narrow >= 0x80).any():
            views.append((narrow.tobytes(), False))
        for data, utf8 in views:
            if not NEXT.match(data):
                continue
            inner = Unfolding(data)
            pieces, held, n = inner.pieces(), [], 0
            for piece in pieces:
                held.append(piece)
                n += len(piece)
                if n > PIECE:
                    break
            if not n:
                continue
            size = inner
            if n > PIECE:  # only now is another look needed at where the data end
                size = Unfolding(data)
                for _ in size.pieces():
                    pass
            b = int(np.searchsorted(first, first[a] + size.used)) if utf8 else a + size.used
            start, end = layer.span(a, b)
            for window, cut in _windows(chain(held, pieces)):
                unfolded = _lax(window)
                yield Layer(unfolded, np.broadcast_to(np.int64(start), len(unfolded)), np.broadcast_to(np.int64(end), len(unfolded))), cut
            if size.ended:
                at = max(at, b)
                break


def _lax(data: bytes) -> str:
    """Bytes as a text that is UTF-8 where it can be; each other byte becomes one character (a lone surrogate)."""
    return data.decode("utf-8", "surrogateescape")


def _narrowed(layer: Layer) -> Iterator[Layer]:
    """The layers that runs of two-byte characters in a layer are; each character has the places of both its bytes."""
    for m in WIDE.finditer(layer.text):
        a, b = m.span()
        places = np.arange(a, b, 2)
        last = np.minimum(places + 1, b - 1)
        start, end = (places, last + 1) if layer.at is None else (np.minimum(layer.at[places], layer.at[last]), np.maximum(layer.to[places], layer.to[last]))
        yield Layer(m[0].replace("\0", ""), start, end)


def _holds(text: str) -> bool:
    """Whether a decoded text has a match or anything to unwrap; most of what base64 decodes to is noise without either."""
    return bool(matches(text) or BASE64.search(text) or URL.search(text) or UNICODE.search(text) or MAGIC.search(text) or "\0" in text and WIDE.search(text))


def _wrapped(lines: list[tuple[int, int, bool]]) -> set[tuple[int, int]]:
    """The runs that lines (start, end, whether padded) may be: all up to padding, and each stretch of equal widths,
    with and without the line before it and a last shorter or padded one. Lines that only happen to stand next to a run may
    be left out so."""
    runs, n = set(), len(lines)
    width = [b - a for a, b, _ in lines]
    i = 0
    for j in range(n):
        if lines[j][2] or j == n - 1:
            runs.add((lines[i][0], lines[j][1]))
            i = j + 1
    i = 0
    while i < n:
        j = i
        while j + 1 < n and not lines[j][2] and width[j + 1] == width[i]:
            j += 1
        last = {j, j + 1} if j + 1 < n and not lines[j][2] and (width[j + 1] < width[i] or lines[j + 1][2]) else {j}
        first = {i, i - 1} if i and not lines[i - 1][2] else {i}
        runs |= {(lines[a][0], lines[b][1]) for a in first for b in last}
        i = j + 1
    return runs


def _encoded(layer: Layer) -> Iterator[Layer]:
    """The layers that base64 runs of a layer hold."""
    for whole in BASE64.finditer(layer.text):
        lines = [(whole.start() + m.start(), whole.start() + m.end(), m[0].endswith("=")) for m in re.finditer(r"[^ \t\r\n]+", whole[0])]
        runs = _wrapped(lines) if len(lines) > 1 else set()
        for a, b, _ in lines:  # each line by itself, and what separators of paths part
            runs.add((a, b))
            runs |= {(a + m.start(), a + m.end()) for m in re.finditer(r"[A-Za-z0-9+]{16,}+={0,2}|[A-Za-z0-9]{16,}+={0,2}", layer.text[a:b])}
        runs |= {(a + k, b) for a, b in runs for k in (1, 2, 3)}  # other letters may stand right before a run
        for a, b in sorted(runs):
            body = "".join(layer.text[a:b].replace("=", "").split()).replace("-", "+").replace("_", "/")
            if len(body) < 16:
                continue
            body = body[: len(body) - (len(body) % 4 == 1)]  # a single character more is no byte
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue
            text = _lax(data)
            if not _holds(text):
                continue
            places = np.array([i for i in range(a, b) if layer.text[i] not in " \t\r\n="][: len(body)])
            start, end = (places, places + 1) if layer.at is None else (layer.at[places], layer.to[places])
            byte = np.concatenate([[0], np.cumsum(_points(text)[1])])
            first, last = byte[:-1] // 3 * 4, np.minimum((byte[1:] - 1) // 3 * 4 + 3, len(places) - 1)
            yield Layer(text, start[first], end[last])


def _within(layer: Layer) -> Iterator[tuple[Layer, int, bool]]:
    """The layers in a layer, how much deeper each is (compressed data count as what they are in), and whether it is cut."""
    if layer.at is not None:
        for x, cut in _unfolded(layer):
            yield x, 0, cut
    if "\0" in layer.text:
        for x in _narrowed(layer):
            yield x, 1, False
    if "%" in layer.text and (x := _replaced(layer, URL.finditer(layer.text), _url)):
        yield x, 1, False
    if "\\" in layer.text or "&#" in layer.text:
        if x := _replaced(layer, UNICODE.finditer(layer.text), _unicode):
            yield x, 1, False
        if ESCAPED.search(layer.text) and (x := _replaced(layer, LITERAL.finditer(layer.text), _literal)):
            for y, cut in _unfolded(x):
                yield y, 1, cut
    for x in _encoded(layer):
        yield x, 1, False


#: A part of how compressed data begin as an escaped byte string.
ESCAPED = re.compile(r"\\x(?:1f|01|9c|da|fd|b5|78)|\\u00(?:1f|01|9c|da|fd|b5|78)|x\^|BZh", re.I)


def scan_text(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int, int]], bool]:
    """The base's spans in order; all spans (start, kind, end, least number of layers unwrapped) in order; whether a
    run over 64 MB in a compressed layer was cut."""
    order = {k: i for i, k in enumerate(KINDS)}
    key = lambda x: (x[0], order[x[1]], x[2])
    base = sorted(matches(text), key=key)
    found = {x: 0 for x in base}
    first = Layer(text)
    seen, cut, work = {hash_of(first): 0}, False, [(_within(first), 0)]
    while work:  # depth first, as windows are not to be held all at once; a layer met again with less around it is done again
        inside, depth = work[-1]
        layer, more, over = next(inside, (None, 0, False))
        if layer is None:
            work.pop()
            continue
        cut |= over
        more += depth
        if seen.get(h := hash_of(layer), more + 1) <= more:
            continue
        seen[h] = more
        for a, kind, b in matches(layer.text):
            start, end = layer.span(a, b)
            x = (start, kind, end)
            found[x] = min(found.get(x, more), more)
        work.append((_within(layer), more))
    return base, [(*x, d) for x, d in sorted(found.items(), key=lambda y: key(y[0]))], cut


def hash_of(layer: Layer) -> bytes:
    """Of the text and its place: equal layers of other places are scanned, a layer that unfolds to itself is not."""
    h = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16)
    for x in (layer.at, layer.to):
        h.update(b"" if x is None else np.ascontiguousarray(x if x.size == 0 or x.strides[0] else x[:1], np.int64).tobytes())
    return h.digest()


def scan(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of `docs`, the text only if asked for, and base, spans (arrays of kind, start, end, layer; code points, end exclusive,
    by start and then kind) and cut (in a compressed layer, a single run or data compressed again are over 64 MB, and were scanned in parts).

    Null and empty texts have no spans; repeated rows each get theirs; columns named like the added ones,
    in letters of either case, are replaced.
    """
    added = ("base", "spans", "cut")
    kept = [f.name for f in others(docs, *added) if keep_text or f.name != text_col]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [scan_text(t) if t else ([], [], False) for t in batch.column(text_col).to_pylist()]
            base = pa.array([[{"kind": k, "start": a, "end": b, "layer": 0} for a, k, b in r[0]] for r in rows], kind)
            spans = pa.array([[{"kind": k, "start": a, "end": b, "layer": d} for a, k, b, d in r[1]] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), base, spans, pa.array([r[2] for r in rows], pa.bool_())], names=[*kept, *added])

    spans = "array<struct<kind: string, start: bigint, end: bigint, layer: int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept).replace(f"`{text_col}` void", f"`{text_col}` string") + f", base {spans}, spans {spans}, cut boolean"
    return docs.select(*[c for c in kept if c != text_col], F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of scan(): counts of the base's kinds, its hash, all spans as text, and cut."""
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, KINDS), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"), "cut")


def redact(found: DataFrame, text_col: str, spans_col: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """`text_col` with every span, overlapping ones as one, replaced by `mark`; other columns as they are."""
    start = {"end": F.lit(0).cast("long"), "out": F.lit("")}
    piece = lambda a, n: F.substring(F.col(text_col), (a + 1).cast("int"), n.cast("int"))
    step = lambda acc, s: F.when(s["start"] >= acc["end"], F.struct(s["end"].alias("end"), F.concat(acc["out"], piece(acc["end"], s["start"] - acc["end"]), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(acc["end"], s["end"]).alias("end"), acc["out"].alias("out")))
    whole = F.aggregate(spans_col, F.struct(*[v.alias(k) for k, v in start.items()]), step, lambda acc: F.concat(acc["out"], piece(acc["end"], F.length(text_col).cast("long"))))
    return found.withColumn(text_col, F.when(F.size(spans_col) > 0, whole).otherwise(F.col(text_col)))
