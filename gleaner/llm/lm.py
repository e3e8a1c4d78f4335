"""LM scoring: stupid-backoff scores from n-gram count tables that are partitioned by hash.

The relations are the usual ones (count n-grams, join the counts to each document's n-grams, sum per document),
but rows hold packed columns instead of single n-grams, as billions of them would otherwise be shuffled with
twenty bytes of row overhead each:

1. Texts are taken in blocks of about ``BLOCK_WORDS`` words.  For each order a block makes the sorted distinct
   hashes of its n-grams with their counts, cut by ranges of the hash into the parts of the count table, of which
   there is one for each ``PART_BYTES`` of input.
2. Each part gathers its share of every block, adds up the counts of equal hashes over all blocks, which is the
   count table of that range, and answers every block with the totals of its own n-grams.
3. Each block gathers the answers, looks up every n-gram of its texts and sums the scores per document.

A block sends no row without n-grams, so rows are at most one for each of its distinct n-grams, and few as long as
the parts are fewer: they grow with the input.  A part is as large at every size of the input; a task may have many,
but holds one at a time.  A hot n-gram is one hash of each block, so counting it costs as much as any other.  All
counts are of all documents.  Blocks are made twice, for their n-grams and for their words, so texts that do not come
straight from files or a checkpoint are checkpointed first, as their order could change.

  S(w | context) is count(context w) / count(context) if the n-gram occurs ``least`` times or more in the
corpus, else ``backoff`` times the score with the context's first word dropped; for one word, count / total.  A
document's first words have as much context as there is.

Words are runs of bytes other than space and 0x09-0x0D, A-Z folded.  Hashes have ``SPARE`` bits more than the number
of n-grams in the corpus needs, so at any size one in 2^28 meets another's hash; 64 at most, which suffices for
6e10 n-grams at that rate.
Defined results: a null or empty text has no words, log_score 0 and a null mean; repeated rows count and are
scored each for itself; without rows the result is empty; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W

BLOCK_WORDS = 1 << 20
#: Estimated bytes of input for each part of the count table, one of which a task holds at a time.
PART_BYTES = 1 << 21
#: Tasks among which parts and blocks are dealt at most.
MOST_TASKS = 1 << 15
ORDER, BACKOFF, LEAST, SPARE = 3, 0.4, 2, 28

_ROWS = "part int, block bigint, kind int, payload binary, counts binary"
_NAMES = ["part", "block", "kind", "payload", "counts"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _press(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpress(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _gram_hashes(words: np.ndarray, row: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: (index of its last word, the hash's leading bits) of every n-gram."""
    away = W.U(64 - bits)
    out, h = [(np.arange(len(words)), words >> away)], words
    for n in range(2, order + 1):
        h = W.mix(h[:-1] * W.U(W._R) + words[n - 1 :]) if len(h) else h
        if len(h) == 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, W.U)))
            continue
        at = np.flatnonzero(row[: len(h)] == row[n - 1 :])
        out.append((at + n - 1, h[at] >> away))
    return out


def _least(part: int, parts: int, bits: int) -> int:
    """The least hash of a part."""
    return -(-(part << 32) // parts) << (bits - 32)


def _requests(block: int, parts: int, words: np.ndarray, per_row: np.ndarray, order: int, bits: int) -> Iterator[tuple]:
    """What a block asks of every part of which it has n-grams."""
    row = np.repeat(np.arange(len(per_row)), per_row)
    for n, (_, h) in enumerate(_gram_hashes(words, row, order, bits), 1):
        distinct, times = np.unique(h, return_counts=True)
        part = ((distinct >> W.U(bits - 32)) * W.U(parts) >> W.U(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            first = _least(int(part[a]), parts, bits)
            yield (int(part[a]), block, n, _press(W.varint(np.diff(distinct[a:b], prepend=W.U(first)))), _press(W.varint(times[a:b])))


def _to_remember(block: int, ids: pa.Array, words: np.ndarray, per_row: np.ndarray) -> tuple:
    """What a block has to remember: ids, words per row, words as ranks of distinct ones."""
    distinct, inverse, times = np.unique(words, return_inverse=True, return_counts=True)
    by_count = np.argsort(-times, kind="stable")
    rank = np.empty(len(by_count), np.int64)
    rank[by_count] = np.arange(len(by_count))
    kept = [_press(W.varint(rank[inverse])), W.varint(np.diff(distinct, prepend=W.U(0))), _press(W.varint(rank))]
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    kept += [_press(ids.fill_null(0).to_numpy().astype("<i8").tobytes()), valid.astype(np.uint8).tobytes(), _press(W.varint(per_row))]
    return (None, block, 0, b"".join(len(k).to_bytes(8, "little") + k for k in kept), None)


def _remembered(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, their validity, words per row, word hashes."""
    fields, at = [], 0
    while at < len(payload):
        n = int.from_bytes(payload[at : at + 8], "little")
        fields.append(payload[at + 8 : at + 8 + n])
        at += 8 + n
    ranks, steps, rank, ids, valid, per_row = fields
    distinct = np.cumsum(W.unvarint(steps), dtype=W.U)
    by_rank = np.empty_like(distinct)
    by_rank[W.unvarint(_unpress(rank)).astype(np.int64)] = distinct
    return np.frombuffer(_unpress(ids), "<i8"), np.frombuffer(valid, np.uint8).astype(bool), W.unvarint(_unpress(per_row)).astype(np.int64), by_rank[W.unvarint(_unpress(ranks)).astype(np.int64)]


def _batches(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3]) + len(r[4] or b"")
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], _NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], _NAMES)


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by the values of ``keys``; one group is held at a time."""
    last, held, where = None, [], [_NAMES.index(k) for k in keys]
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = tuple(r[i] for i in where)
            if held and k != last:
                yield last, held
                held = []
            last = k
            held.append(r)
    if held:
        yield last, held


def _by_block(block_words: int, make):
    """Rows of ``make`` (block, ids, words, words per row) for each block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, count = TaskContext.get().partitionId(), 0

        def rows() -> Iterator[tuple]:
            nonlocal count
            ids, hashes, per_row, total = [], [], [], 0
            for batch in batches:
                for lo, hi, data, offsets in W.blocks(batch.column("text")):
                    words = W.split(data, offsets, fold=True)
                    ids.append(batch.column("doc_id").slice(lo, hi - lo))
                    hashes.append(words.hash)
                    per_row.append(words.count)
                    total += len(words.hash)
                    if total >= block_words:
                        yield from make((partition << 32) + count, pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(per_row))
                        ids, hashes, per_row, total, count = [], [], [], 0, count + 1
            if ids:
                yield from make((partition << 32) + count, pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(per_row))

        yield from _batches(rows())

    return run


def _totals(hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each hash, the sum of the times of all that equal it."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(np.append(first, len(order))))
    return out


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (part, kind), own in _groups(batches, "part", "kind"):
            # all steps of a part begin at its least hash, so that may be left out
            hashes = [np.cumsum(W.unvarint(_unpress(r[3])), dtype=W.U) for r in own]
            times = np.concatenate([W.unvarint(_unpress(r[4])) for r in own]).astype(np.int64)
            blocks = [r[1] for r in own]
            own.clear()
            cut = np.cumsum([0, *map(len, hashes)])
            total = _totals(np.concatenate(hashes), times)
            for block, a, b in zip(blocks, cut[:-1], cut[1:], strict=True):
                yield (part, block, kind, _press(W.varint(total[a:b])), None)

    yield from _batches(rows())


def _sum(order: int, total: int, backoff: float, least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, "block"):
            group.sort(key=lambda r: (r[2], r[0] or 0))
            ids, valid, per_row, words = _remembered(group[0][3])
            row = np.repeat(np.arange(len(per_row)), per_row)
            score, before = np.zeros(len(words)), np.zeros(0)
            for n, (at, h) in enumerate(_gram_hashes(words, row, order, bits), 1):
                answers = [W.unvarint(_unpress(r[3])) for r in group if r[2] == n]
                if not answers:
                    break
                times = np.concatenate(answers)[np.unique(h, return_inverse=True)[1]].astype(np.float64)
                if n == 1:
                    score = np.log(times / total)
                    seen = times
                else:  # the context of the n-gram that ends at a word ends at the word before it
                    context = before[at - 1]
                    found = times >= least
                    score[at] = np.where(found, np.log(times / context), math.log(backoff) + score[at])
                    seen = np.full(len(words), np.nan)
                    seen[at] = times
                before = seen
            sums = np.bincount(row, score, len(per_row))
            mean = sums / np.maximum(per_row, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~valid), pa.array(per_row), pa.array(sums), pa.array(mean, mask=per_row == 0)], ["doc_id", "n_words", "log_score", "mean_log_score"])

    return run


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, parts: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm) and mean_log_score of every row, by counts of all rows."""
    own = S.documents(docs, id_col, text_col)
    S.ready(docs.sparkSession)
    if not S.stands_still(own):
        own = S.kept(own)
    total = own.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    bits = min(64, max(40, (order * total).bit_length() + SPARE))
    parts = parts or max(32, S.parts_for(own, PART_BYTES, most=1 << 31))
    tasks = min(parts, MOST_TASKS)
    asked = own.mapInArrow(_by_block(block_words, lambda block, ids, words, per_row: _requests(block, parts, words, per_row, order, bits)), _ROWS)
    asked = asked.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    answered = asked.sortWithinPartitions("part", "kind", "block").mapInArrow(_answer, _ROWS)
    # first in the union, so that its partitions have the numbers they have alone, which blocks are named by
    remembered = own.mapInArrow(_by_block(block_words, lambda *block: [_to_remember(*block)]), _ROWS)
    place = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(tasks)).cast("int")
    met = remembered.unionByName(answered).repartitionById(tasks, place).sortWithinPartitions("block")
    return met.mapInArrow(_sum(order, max(total, 1), backoff, least, bits), "doc_id bigint, n_words bigint, log_score double, mean_log_score double")
