"""Secret scans: a worklist of decoded layers, each scanned again and mapped back to the text.

Base patterns run over the whole text.  Then every layer on the worklist is unwrapped: percent escapes and
Unicode escapes are replaced throughout the layer, base64 runs are decoded one by one in each of four alignments, and
gzip, zlib, bzip2, xz or zstd data are decompressed wherever they begin in decoded bytes, one stream after another.
Percent and byte escapes mixed with bare characters are read as bytes too.  Of bytes that aren't text as a whole, the
stretches of UTF-8 and of ASCII as UTF-16 that are long enough for a secret become layers.  Each new layer is scanned with the same
patterns and goes on the worklist, until nothing new appears.  A layer is not taken up again if its content was
seen before over the same range of the document, so cycles (an archive that holds itself) end.  Every character of a layer
carries the range of the original text that it came from; a finding in a layer covers the ranges of its
characters, the whole run where bytes were decompressed.

Defined results: a null or empty text has no spans; equal spans of different layers count once; repeated rows
give repeated results; other columns of the input are neither read nor returned by ``scan``.
Bound: the layers of one document decode to at most ``MAX_DECODED`` characters together, or ``MORE`` times its own
length if that is more, so that only decompression or very deep nesting reaches it; what is left is counted in
``n_unfinished``, and ``redact`` masks the range it came from.  Base findings have no bound.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S

KINDS = ("assign", "access", "hex")
#: Decoded characters of one document's layers together.
MAX_DECODED = 1 << 25
#: Layers as long as the document that fit whatever its length.
MORE = 64

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{56,128}\r?\n)+[A-Za-z0-9+/_-]+={0,2}")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

#: No secret is shorter: "token=" and six characters.
SHORTEST = 12
_CHUNK = 1 << 16
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]++|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})++")
_UTF16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}+|(?:\x00[\t\n\r\x20-\x7e]){12,}+")
#: Bytes as escapes and bare characters, as encoders of URLs and of string literals write them.
_QUOTED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+!*'(),;:@&=$-])++")
_LITERAL = re.compile(r"[\x20-\x7e]+")
_QUOTED_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|(.)")
_LITERAL_BYTE = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|(\\[tnrabfv0\\'\"]|.)")
_SHORT = {"\\t": 9, "\\n": 10, "\\r": 13, "\\a": 7, "\\b": 8, "\\f": 12, "\\v": 11, "\\0": 0}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Findings in one text as it stands, leftmost and non-overlapping by kind."""
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class _Layer:
    """A text with the range of the original behind each character; for the original itself, no arrays."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, cut: bool = False):
        self.text, self.start, self.end, self.cut = text, start, end, cut
        self.source: tuple[int, int] | None = None  # of a layer that came from one range, even an empty one

    def range(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None or self.end is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def key(self) -> tuple[bytes, tuple[int, int]]:
        """Content and range; equal for layers that a cycle comes back to."""
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.range(0, len(self.text)) if self.text else (0, 0)

    def ranges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the characters a to b - 1, pairwise; what a piece came from is increasing within a layer."""
        if self.start is None or self.end is None:
            return a, b
        return self.start[a], self.end[b - 1]


def _stream(decoder, data: memoryview, room: int) -> tuple[bytes, int]:
    """Decompressed bytes, at most ``room`` + 1, and how many bytes of ``data`` they took; fed in chunks, so that many short streams in a row stay cheap."""
    out, n, at = [], 0, 0
    while at < len(data) and n <= room and not decoder.eof:
        chunk = data[at : at + _CHUNK]
        try:
            out.append(decoder.decompress(chunk, room + 1 - n))
        except Exception:
            if not n:
                raise
            return b"".join(out), at
        at += len(chunk)
        n += len(out[-1])
    return b"".join(out), at - len(decoder.unused_data)


def _inflate(data: memoryview, room: int) -> tuple[bytes, int] | None:
    """Decompressed bytes and how many bytes they took, None if ``data`` isn't compressed."""
    head = bytes(data[:6])
    try:
        if head[:2] == b"\x1f\x8b":
            return _stream(zlib.decompressobj(31), data, room)
        if head[:1] == b"\x78":
            return _stream(zlib.decompressobj(), data, room)
        if head[:3] == b"BZh":
            return _stream(bz2.BZ2Decompressor(), data, room)
        if head == b"\xfd7zXZ\x00":
            return _stream(lzma.LZMADecompressor(), data, room)
        if head[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            return zstandard.ZstdDecompressor().stream_reader(data).read(room + 1), 4  # where a frame ends isn't told
    except Exception:  # any decoder's own error: then it wasn't such data
        return None
    return None


def _unpacked(data: bytes, room: int) -> Iterator[tuple[int, int, str, bool]]:
    """Texts in the streams that begin anywhere in ``data``, and in streams within these: first byte, byte after the last, text, whether cut for want of room."""
    todo, seen = deque([(data, None)]), {data}
    while todo:
        data, range_ = todo.popleft()
        at, view = 0, memoryview(data)
        while m := _MAGIC.search(data, at):
            at = m.start() + 1
            if not (got := _inflate(view[m.start() :], room)) or not got[0]:
                continue
            out, used = got
            a, b = range_ or (m.start(), len(data) if used == 4 else m.start() + used)
            at = max(at, m.start() + used)
            cut = len(out) > room
            out = out[:room]
            if out in seen and not cut:
                continue
            seen.add(out)
            room -= len(out)
            texts = [t for _, _, t in _stretches(out)] + [t for _, _, t in _wide(out)]
            for text in texts:
                yield a, b, text, False
            if cut:
                yield a, b, "", True
            todo.append((out, (a, b)))


def _stretches(data: bytes) -> Iterator[tuple[int, int, str]]:
    """First byte, byte after the last and text of the whole, if it is text, else of its stretches of text."""
    try:
        text = data.decode("utf-8")
        if not _CONTROL.search(text):
            yield 0, len(data), text
            return
    except UnicodeDecodeError:
        pass
    for m in _TEXT.finditer(data):
        if m.end() - m.start() >= SHORTEST:
            yield m.start(), m.end(), m[0].decode("utf-8")


def _wide(data: bytes) -> Iterator[tuple[int, int, str]]:
    """Stretches of ASCII written as UTF-16."""
    if b"\0" in data:
        for m in _UTF16.finditer(data):
            yield m.start(), m.end(), m[0].replace(b"\0", b"").decode("ascii")


def _replaced(layer: _Layer, runs: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> _Layer:
    """The layer with ranges of it replaced; each run: start, end, new text, and the layer's range behind each new character."""
    parts, starts, ends, at = [], [], [], 0
    for a, b, text, sa, sb in runs:
        parts += [layer.text[at:a], text]
        starts += [np.arange(at, a), sa]
        ends += [np.arange(at, a) + 1, sb]
        at = b
    parts.append(layer.text[at:])
    starts.append(np.arange(at, len(layer.text)))
    ends.append(starts[-1] + 1)
    s, e = np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)
    return _Layer("".join(parts), *layer.ranges(s, e))


def _utf8_sizes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def _percent(layer: _Layer, room: int) -> Iterator[_Layer]:
    if "%" not in layer.text:
        return
    runs = []
    for m in _PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            continue  # _escaped reads it as bytes
        to = np.cumsum(_utf8_sizes(text)) * 3 + m.start()
        runs.append((m.start(), m.end(), text, np.concatenate([[m.start()], to[:-1]]), to))
    if runs:
        yield _replaced(layer, runs)


def _unicode(layer: _Layer, room: int) -> Iterator[_Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    runs = []
    for m in _ESCAPE.finditer(layer.text):
        units = [(x.start() + m.start(), x.end() + m.start(), int(x[4]) if x[4] else int(x[1] or x[2] or x[3], 16)) for x in _ONE_ESCAPE.finditer(m[0])]
        if any(v > 0x10FFFF for _, _, v in units):
            continue
        if max(v for _, _, v in units) <= 0xFF and (got := list(_unpacked(bytes(v for _, _, v in units), room))):
            for a, b, text, cut in got:
                yield _whole(layer, units[a][0], units[b - 1][1], text, cut)
            continue
        chars, sa, sb = [], [], []
        for a, b, v in units:
            if chars and 0xDC00 <= v <= 0xDFFF and 0xD800 <= ord(chars[-1]) <= 0xDBFF:
                chars[-1] = chr(0x10000 + ((ord(chars[-1]) - 0xD800) << 10) + v - 0xDC00)
                sb[-1] = b
            else:
                chars.append(chr(v))
                sa.append(a)
                sb.append(b)
        text = "".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in chars)
        runs.append((m.start(), m.end(), text, np.array(sa), np.array(sb)))
    if runs:
        yield _replaced(layer, runs)


def _escaped(layer: _Layer, room: int) -> Iterator[_Layer]:
    """Compressed data and UTF-16 in runs of escapes and bare characters; text in them is ``_percent``'s and ``_unicode``'s."""
    for mark, run, one in (("%", _QUOTED, _QUOTED_BYTE), ("\\", _LITERAL, _LITERAL_BYTE)):
        if mark not in layer.text:
            continue
        for m in run.finditer(layer.text):
            if mark == "\\" and "\\x" not in m[0] and "\\u00" not in m[0] or mark not in m[0]:
                continue
            units = list(one.finditer(m[0]))
            data = bytes(int(u[1], 16) if u[1] else _SHORT.get(u[2], ord(u[2][-1])) for u in units)
            tries = [data, bytes(0x20 if u[2] == "+" else c for u, c in zip(units, data, strict=True))] if mark == "%" and "+" in m[0] else [data]
            for data in tries:
                for a, b, text, cut in itertools.chain(_unpacked(data, room), ((*w, False) for w in _wide(data))):
                    yield _whole(layer, m.start() + units[a].start(), m.start() + units[b - 1].end(), text, cut)


def _whole(layer: _Layer, a: int, b: int, text: str, cut: bool) -> _Layer:
    s, e = layer.range(a, b)
    out = _Layer(text, np.full(len(text), s), np.full(len(text), e), cut)
    out.source = s, e
    return out


def _base64(layer: _Layer, room: int) -> Iterator[_Layer]:
    found = list(_BASE64.finditer(layer.text))
    if not found:
        return
    if "\n" in layer.text:
        found += _WRAPPED.finditer(layer.text)
    for m in found:
        run = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        where = np.arange(m.start(), m.start() + len(run))
        if "\n" in run:
            keep = np.array([c not in "\r\n" for c in run])
            where, run = where[keep], "".join(c for c in run if c not in "\r\n")
        for skip in range(4):
            rest = run[skip:]
            rest = rest[: len(rest) - (len(rest) % 4 == 1)]
            if len(rest) < 12:
                break
            try:
                data = base64.b64decode(rest + "=" * (-len(rest) % 4))
            except (binascii.Error, ValueError):
                continue
            char = lambda byte, skip=skip: min(byte * 8 // 6 + skip, len(where) - 1)
            packed = list(_unpacked(data, room))
            for a, b, text, cut in itertools.chain(packed, ((*w, False) for w in _wide(data))):
                if a == skip == 0:
                    yield _whole(layer, m.start(), m.end(), text, cut)
                else:
                    yield _whole(layer, int(where[char(a)]), int(where[min((b * 8 - 1) // 6 + skip, len(where) - 1)]) + 1, text, cut)
            for a, b, text in _stretches(data):
                inside = [text[x:y] for _, x, y in base_spans(text)] if packed else []
                if inside and any(lo <= a and b <= hi and all(x in t for x in inside) for lo, hi, t, _ in packed):
                    continue  # stored bytes of a stream that was unpacked
                if text:
                    to = np.cumsum(_utf8_sizes(text)) + a
                    first = (np.concatenate([[a], to[:-1]]) * 8 // 6) + skip
                    last = ((to * 8 - 1) // 6) + skip
                    yield _Layer(text, *layer.ranges(where[first], where[np.minimum(last, len(where) - 1)] + 1))


DECODERS = (_percent, _unicode, _escaped, _base64)


def scan_text(text: str, max_decoded: int = MAX_DECODED) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, layers decoded and layers left because of ``max_decoded``; spans by start, then kind."""
    base, spans, layers, left = _scan(text, max_decoded)
    return base, spans, layers, len(left)


def _scan(text: str, max_decoded: int) -> tuple[list[Span], list[Span], int, list[tuple[int, int]]]:
    """As ``scan_text``, but with the range of the text that each layer left came from."""
    order = lambda spans: sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    base = base_spans(text)
    first = _Layer(text)
    spans, seen, room = set(base), {first.key()}, max(max_decoded, MORE * len(text))
    left: list[tuple[int, int]] = []
    todo = deque([first])
    while todo:
        layer = todo.popleft()
        for decoder in DECODERS:
            for new in decoder(layer, max(room, 0)):
                if new.cut:
                    left.append(new.source or new.range(0, len(new.text)))
                if not new.text or (key := new.key()) in seen:
                    continue
                seen.add(key)
                if len(new.text) > room:
                    left.append(new.source or new.range(0, len(new.text)))
                    continue
                room -= len(new.text)
                spans.update((kind, *new.range(a, b)) for kind, a, b in base_spans(new.text))
                todo.append(new)
    return order(base), order(spans), len(seen) - 1, left


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_unfinished bigint"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base findings, all spans, layers.  No shuffle."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base, spans, layers, left = scan_text(text or "")
            rows.append((doc, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), layers, left))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], SCHEMA.replace(" bigint", "").replace(" string", "").split(", "))

    return S.map_arrow(S.documents(docs, id_col, text_col), step, SCHEMA)


def redact_text(text: str, max_decoded: int = MAX_DECODED) -> str:
    """The text with each secret replaced by [kind], and by [unfinished] what was not decoded to its end; overlapping spans are one, named by the first."""
    _, spans, _, left = _scan(text, max_decoded)
    if left:
        spans = sorted([*spans, *(("unfinished", a, b) for a, b in left)], key=lambda s: s[1])
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """``redact_text`` of a string column; null stays null."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redact_text, na_action="ignore")

    return run(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets masked in ``text_col``; all columns and rows stay."""
    S.ready(docs.sparkSession)
    return docs.withColumn(text_col, redacted(F.col(text_col).cast("string")))
