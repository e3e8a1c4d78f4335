"""Benchmark decontamination: spaced-seed hashing with substitution-tolerant verification.

Words are runs of letters and digits, A-Z folded; punctuation, symbols and spaces of all scripts part them, and
each character of a script written without spaces (``UNSPACED``) is a word, so that for these ``LEAST`` and
``SHORTEST`` count characters.  Each fixed mask of ``MASKS`` hashes the words at its ones and
ignores those at its zeros, at every position of every benchmark item and document.  Where a document's hash is
one of the items', the two are laid over each other at that offset and compared word by word over their whole
overlap; the segment that scores most (1 a match, -2 a substitution) is an overlap if it has ``LEAST`` matches
and these are at least ``PERCENT`` of it.  Items of fewer than ``LEAST`` words, but at least ``SHORTEST``, count where they occur
whole; still shorter ones occur in any prose, so they count where they are all the words of a document.

With ``whole``, as in the registered query and the pipeline, an item of at least ``SHORTEST`` words also counts where
that percentage of all its words stands in the document under one offset, wherever the substitutions are; words
beyond the document's ends count as substituted.  At 75 % no such place is missed: if at most a quarter of five or
more words is substituted, one mask of ``CLOSE`` still has all its ones (three in a row, or 1101 where items of five
or eight words leave only pairs).  A segment is given where there is one, else the whole item.

The benchmark is joined on the map side, as a table of hashes held by each worker; it goes over the documents in
blocks of about ``BLOCK_BYTES`` of text, one block for any usual benchmark, so what is broadcast is bounded: where
there are several, what one finds is checkpointed and its table dropped before the next is sent.  No shuffle.

Defined results: null or empty texts and items overlap with nothing; repeated documents give repeated rows,
repeated items count each for itself; the best overlap of a document and item is given, the first of equals;
without items or documents the result is empty; other columns are not read by ``overlaps`` and all stay in
``clean``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W

MASKS = ("110111", "1101011", "11001011", "1010110001")
CLOSE = ("111", "1101")
LEAST, SHORTEST = 12, 5
MISMATCH, PERCENT = 2, 75
BLOCK_BYTES = 1 << 25
_BITS = 22
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}\x{FF70}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Tham}\p{Tai_Viet}\p{Javanese}\p{Balinese}"
#: Beyond ASCII: punctuation, symbols, spaces, C1 controls, zero-width space and byte order mark, variation selectors.
_PARTING = r"\p{P}\p{S}\p{Z}\x{80}-\x{9F}\x{200B}\x{FEFF}\x{FE00}-\x{FE0F}"
#: Words of items laid over documents at once.
_LAID = 1 << 20


def _seeds(words: W.Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the mask at every place where its span lies in one row."""
    span, total = len(mask), len(words.hash)
    if total < span:
        return np.zeros(0, np.int64), np.zeros(0, W.U)
    h = np.full(total - span + 1, int(mask, 2), W.U)
    for i, used in enumerate(mask):
        if used == "1":
            h = h * W.U(W._R) + words.hash[i : total - span + 1 + i]
    at = np.flatnonzero(words.row[: total - span + 1] == words.row[span - 1 :])
    return at, W.mix(h[at])


def _parted(column: pa.Array) -> pa.Array:
    """The texts with ASCII spaces for what parts words beyond ASCII, and around each character that is a word."""
    column = column.cast(pa.large_string())
    beyond = pc.invert(pc.string_is_ascii(column))
    if not pc.any(beyond).as_py():
        return column
    texts = column.filter(beyond)
    texts = pc.replace_substring_regex(texts, f"[{_PARTING}]", " ")
    texts = pc.replace_substring_regex(texts, f"([{UNSPACED}])", r" \1 ")
    return pc.replace_with_mask(column, pc.fill_null(beyond, False), texts)


def _words(column: pa.Array) -> Iterator[tuple[int, W.Words]]:
    for lo, _, data, offsets in W.blocks(_parted(column)):
        yield lo, W.split(data, offsets, fold=True, between=W.MARKS)


class _Seeds:
    """Seeds sorted by hash, each with its item and place."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        h, item, place = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, W.U if not i else np.int64) for i in range(3))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.some = np.zeros(1 << _BITS, bool)  # a first look-up that most hashes fail
        self.some[self.hash >> W.U(64 - _BITS)] = True

    def hits(self, words: W.Words, seeds: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Distinct (row, item, word of the row under the item's first word)."""
        out = [np.zeros((0, 3), np.int64)]
        for at, h in seeds:
            maybe = np.flatnonzero(self.some[h >> W.U(64 - _BITS)])
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            times = hi - lo
            at, lo = np.repeat(at, times), np.repeat(lo, times)
            which = lo + np.arange(len(lo)) - np.repeat(np.cumsum(times) - times, times)
            out.append(np.stack([words.row[at], self.item[which], at - words.first[words.row[at]] - self.place[which]], 1))
        return np.unique(np.concatenate(out), axis=0)


class Index:
    """Of some items: their word hashes and seeds."""

    def __init__(self, ids: list[int], texts: list[str], least: int = LEAST, shortest: int = SHORTEST, whole: int | None = None):
        self.ids, self.items, self.least, self.whole = ids, [], least, whole
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        close: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.lengths: set[int] = set()
        self.brief: dict[bytes, list[int]] = {}
        for lo, words in _words(pa.array(texts, pa.string())):
            self.items += [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            long = words.count[words.row] >= least
            for mask in MASKS:
                at, h = _seeds(words, mask)
                at, h = at[long[at]], h[long[at]]
                found.append((h, words.row[at] + lo, at - words.first[words.row[at]]))
            for n in np.unique(words.count[(words.count >= shortest) & (words.count < least)]):
                self.lengths.add(int(n))
                at, h = W.grams(words, int(n))
                all_of = words.count[words.row[at]] == n
                found.append((h[all_of], words.row[at][all_of] + lo, np.zeros(int(all_of.sum()), np.int64)))
            for mask in CLOSE if whole is not None else ():
                at, h = _seeds(words, mask)
                some = words.count[words.row[at]] >= shortest
                at, h = at[some], h[some]
                close.append((h, words.row[at] + lo, at - words.first[words.row[at]]))
        self.seeds, self.close = _Seeds(found), _Seeds(close)
        for i, own in enumerate(self.items):
            if 0 < len(own) < shortest:
                self.brief.setdefault(own.tobytes(), []).append(i)
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.own = np.concatenate(self.items) if self.items else np.zeros(0, W.U)

    def _laid(self, words: W.Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, word of the row under the item's first word, matches) where ``whole`` percent of an item's words match."""
        hits = self.close.hits(words, (_seeds(words, m) for m in CLOSE))
        ends = np.cumsum(self.sizes[hits[:, 1]])
        lo = 0
        while lo < len(hits):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _LAID, "right")))
            row, item, shift = hits[lo:hi].T
            n = self.sizes[item]
            begin = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(begin, n)
            place = inside + np.repeat(shift, n)
            there = (place >= 0) & (place < np.repeat(words.count[row], n))
            place = np.where(there, place + np.repeat(words.first[row], n), 0)
            same = there & (words.hash[place] == self.own[inside + np.repeat(self.first[item], n)])
            matches = np.add.reduceat(same, begin, dtype=np.int64)
            good = 100 * matches >= self.whole * n
            yield from zip(row[good].tolist(), item[good].tolist(), shift[good].tolist(), matches[good].tolist(), strict=True)
            lo = hi

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item's number, matches, aligned words, word of the document, word of the item), one for each row and item."""
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        near: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        if not len(self.seeds.hash) and not self.brief:
            return []
        most = max(map(len, self.brief), default=0) // 8
        for base, words in _words(column):
            for row in np.flatnonzero((words.count > 0) & (words.count <= most)).tolist():
                own = words.hash[words.first[row] : words.first[row + 1]]
                for item in self.brief.get(own.tobytes(), ()):
                    best[row + base, item] = (len(own), len(own), 0, 0)
            for row, item, shift, matches in self._laid(words) if self.whole is not None else ():
                doc, n = int(words.count[row]), len(self.items[item])
                a, b = max(0, -shift), min(n, doc - shift)
                if matches > near.get((row + base, item), (0,))[0]:
                    near[row + base, item] = (matches, b - a, a + shift, a)
            for row, item, shift in self.seeds.hits(words, itertools.chain((_seeds(words, m) for m in MASKS), (W.grams(words, n) for n in self.lengths))).tolist():
                doc, own = words.hash[words.first[row] : words.first[row + 1]], self.items[item]
                a, b = max(0, -shift), min(len(own), len(doc) - shift)
                sums = np.zeros(b - a + 1, np.int64)
                same = own[a:b] == doc[a + shift : b + shift]
                np.cumsum(np.where(same, 1, -MISMATCH), out=sums[1:])
                end = int((sums - np.minimum.accumulate(sums)).argmax())
                start = int(sums[: end + 1].argmin())
                matches = int(same[start:end].sum())
                key = (row + base, item)
                if matches >= min(self.least, len(own)) and 100 * matches >= PERCENT * (end - start) and matches > best.get(key, (0,))[0]:
                    best[key] = (matches, end - start, start + a + shift, start + a)
        return [(*k, *v) for k, v in sorted((near | best).items())]


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, least: int, shortest: int, whole: int | None) -> Iterator[Index]:
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        yield Index([r.item_id for r in rows], [r.text for r in rows], least, shortest, whole)


_SCHEMA = "doc_id bigint, item_id bigint, matched bigint, aligned bigint, item_words bigint, doc_word bigint, item_word bigint"


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", whole: int | None = None) -> DataFrame:
    """One row for each document and item that overlap."""
    own = S.documents(docs, id_col, text_col)
    out = sent = None
    for index in _indexes(benchmark, item_col, item_text_col, least, shortest, whole):
        if out is not None:
            out = S.kept(out)
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def step(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            index, ids = sent.value, batch.column("doc_id").to_pylist()
            rows = [(ids[r], index.ids[i], m, n, len(index.items[i]), d, w) for r, i, m, n, d, w in index.search(batch.column("text"))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

        found = S.map_arrow(own, step, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, shortest: int = SHORTEST, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", whole: int | None = None) -> DataFrame:
    """``docs`` without the rows that overlap with an item."""
    S.ready(docs.sparkSession)
    sent = None
    for index in _indexes(benchmark, item_col, item_text_col, least, shortest, whole):
        if sent is not None:
            docs = S.kept(docs)
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(_free(sent)(F.col(text_col).cast("string")))
    return docs


def _free(sent):
    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        out[[r[0] for r in sent.value.search(pa.array(texts, pa.large_string(), from_pandas=True))]] = False
        return pd.Series(out)

    return free
