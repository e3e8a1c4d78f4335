"""Packing: bounded-space online best fit of token sequences.

Each partition keeps ``open_windows`` partly filled windows of ``size`` ids.  A document's whole windows go
out at once; what remains of it goes into the open window that it fills best.  Where none has room and no
further window may be opened, the fullest is filled up with the head of the remainder and goes out, so cutting
replaces padding.  At its end a partition pours its open windows together, which leaves it one partly filled
window at most; those are poured together in turn, ``FAN_IN`` partitions a group, round by round, until one
window of the whole input is left.  Only that one is padded.

Ids are those that ``tokenizers`` gives for a byte-level BPE file, without special tokens added; what a text holds
literally of an added token, such as ``<|endoftext|>``, is that token's id there.  Words between single spaces are
encoded once per worker and remembered (``REMEMBERED`` at most), which changes nothing: a space that no white space
stands next to always begins a new piece of this vocabulary's pattern.

Defined results: a null or empty text is its end id alone; repeated rows are packed each for itself; a null
doc_id stays null.  Sequence ids follow from the partition and the order within it, so a task that is run again
over the same files makes the same sequences; the pieces are checkpointed before windows are poured together.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S

#: Partitions whose last windows are poured together by one task.
FAN_IN = 64
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
#: White space side by side, and the spaces with none beside them.
_RUN, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")


class _Words(dict):
    """Ids of " word" as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts as ``tokenizers`` gives them for ``path``, a file of its own (.json).

    Where the same vocabulary's ranks lie beside it (.tiktoken), words are merged by the faster library, whose ids
    are the same; texts with an added token are left to the slower one.
    """

    def __init__(self, path: str):
        import base64
        import os

        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.whole = self.encode = lambda text: own.encode(text, add_special_tokens=False).ids
        self.added = re.compile("|".join(re.escape(t.content) for t in own.get_added_tokens_decoder().values()) or r"(?!)")
        ranks_file = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks_file):
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self.encode)

    def ids(self, text: str) -> bytes:
        if self.added.search(text):
            return np.array(self.whole(text), "<u4").tobytes()
        head, *rest = _CUT.split(text) if _RUN.search(text) else text.split(" ")
        return np.array(self.encode(head), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: doc_id, start, doc_tokens and the ids' bytes.
Piece = tuple[int | None, int, int, bytes]


class Windows:
    """The open windows of one partition.  ``emit``: called with the pieces of each window that goes out."""

    def __init__(self, size: int, most: int, emit):
        self.size, self.most, self.emit = size, most, emit
        self.open: list[tuple[int, int]] = []  # (ids that still fit, key), ascending
        self.held: dict[int, list[Piece]] = {}
        self.next = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.size:
            self.emit([(doc, at, n, ids[4 * at : 4 * (at + self.size)])])
            at += self.size
        while at < n:
            i = bisect_left(self.open, (n - at, -1))
            if i < len(self.open):
                room, key = self.open.pop(i)
            elif len(self.open) < self.most:
                room, key, self.next = self.size, self.next, self.next + 1
                self.held[key] = []
            else:
                room, key = self.open.pop(0)
            take = min(room, n - at)
            self.held[key].append((doc, at, n, ids[4 * at : 4 * (at + take)]))
            at += take
            if take == room:
                self.emit(self.held.pop(key))
            else:
                insort(self.open, (room - take, key))

    def close(self) -> list[Piece]:
        """Pours the open windows together, the fullest first; returns the pieces that don't fill a window."""
        return pour([p for _, key in self.open for p in self.held[key]], self.size, self.emit)


def pour(pieces: list[Piece], size: int, emit) -> list[Piece]:
    window, room = [], size
    for doc, start, total, ids in pieces:
        while ids:
            take = min(room, len(ids) // 4)
            window.append((doc, start, total, ids[: 4 * take]))
            start, ids, room = start + take, ids[4 * take :], room - take
            if not room:
                emit(window)
                window, room = [], size
    return window


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_STEP = SCHEMA + ", part bigint, ids binary"
_TYPES = [pa.int64()] * 8 + [pa.binary()]
_NAMES = [x.split()[0] for x in _STEP.split(", ")]


def _rows(pieces: list[Piece], sequence: int, part: int | None = None) -> list[tuple]:
    out, offset = [], 0
    for doc, start, total, ids in pieces:
        out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, part, None if part is None else ids))
        offset += len(ids) // 4
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, open_windows: int = 64, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; the columns of ``SCHEMA``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done, count = encoder(tokenizer), TaskContext.get().partitionId(), [], 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal count
            done.extend(_rows(pieces, (part << 32) + count))
            count += 1

        windows = Windows(size, open_windows, emit)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                windows.add(doc, (enc.ids(text) if text else b"") + end)
                if len(done) > 4096:
                    yield _batch(done)
                    done.clear()
        done.extend(_rows(windows.close(), (part << 32) + count, part))
        if done:
            yield _batch(done)

    S.ready(docs.sparkSession)
    made = S.kept(S.documents(docs, id_col, text_col).mapInArrow(run, _STEP))
    out, level = made.where("part IS NULL"), 0
    left = made.where("part IS NOT NULL")
    while True:
        level += 1
        groups = left.agg(F.max("part")).first()[0]
        if groups is None:
            break
        last = groups < FAN_IN
        merged = left.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(_merge(size, level, last), _STEP)
        if last:
            out = out.unionByName(merged)
            break
        merged = S.kept(merged)
        out, left = out.unionByName(merged.where("part IS NULL")), merged.where("part IS NOT NULL")
    return out.select(*_NAMES[:7])


def _merge(size: int, level: int, last: bool):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        part, done = int(rows["part"].iloc[0]), []
        rows = rows.sort_values(["sequence_id", "offset"])
        base = (level << 58) + (part << 32)
        emit = lambda pieces: done.extend(_rows(pieces, base + len(done)))
        ids = rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None)
        pieces = [(None if d is None else int(d), int(s), int(n), bytes(b)) for d, s, n, b in zip(ids, rows["start"], rows["doc_tokens"], rows["ids"], strict=True)]
        rest = pour(pieces, size, emit)
        done.extend(_rows(rest, base + len(done), None if last else part))
        out = pd.DataFrame(done, columns=_NAMES)
        return out.astype({c: "Int64" for c in ("doc_id", "part")})

    return merge
