"""Language ID: script ranges narrow candidates, then Viterbi over per-word scores with a switching penalty.

A word is a maximal run of letters (str.isalpha).  Its score for a language is the sum of log probabilities of
its letter trigrams, with the word's edges, learned from a labelled sample.  The word's script, that of its
first letter by code-point range, narrows the candidates to the languages that write at least ``SCRIPT_SHARE`` of
their letters in it; a script that none writes narrows nothing and says nothing.  Viterbi then finds the best
sequence of languages over the whole text, at ``PENALTY`` a switch, so short foreign words don't split a text but
foreign passages are spans of their own.  The text's language is that of most of its letters.

All texts of a block advance together, one word a step, so a step is a few vector operations.
Learned only from rows with a language whose crc32(doc_id as text) mod 4 is not 2, at most ``SAMPLE`` of them.
Defined results: a null text, or one without a letter, is ``und`` with score 0 and no span; ties go to the
language that sorts first; without labelled rows every text is ``und``; an id's several languages count by the
least; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W
from ._sample import labelled

#: Labelled rows that are learned from.
SAMPLE = 4096
BUCKETS = 1 << 16
PENALTY = 12.0
SCRIPT_SHARE = 0.01
_FAR = np.float32(-1e4)

#: First code points of ranges and the scripts they begin (0: Latin).
_RANGES = [(0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x700, 6), (0x750, 5), (0x780, 6), (0x8A0, 5), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 8), (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x1380, 8), (0x1780, 13), (0x1800, 8), (0x1C80, 2), (0x1C90, 10), (0x1D00, 0), (0x1F00, 1), (0x2000, 0), (0x2C80, 8), (0x2E80, 14), (0x3040, 15), (0x3100, 14), (0x3130, 11), (0x31F0, 15), (0x3200, 14), (0xA000, 8), (0xA640, 2), (0xA6A0, 8), (0xA720, 0), (0xA800, 8), (0xAC00, 11), (0xD800, 8), (0xF900, 14), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 8), (0xFE70, 5), (0xFF21, 0), (0xFF66, 15), (0xFFA0, 11), (0x10000, 8), (0x20000, 14), (0x30000, 14)]
_STARTS, _SCRIPTS = (np.array(c) for c in zip(*_RANGES, strict=True))
N_SCRIPTS = 16
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case where that is one code point."""
    if not _TABLES:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                low = c.lower()
                if low != c and len(low) == 1:
                    lower[i] = ord(low)
        _TABLES.extend([letter, lower])
    return _TABLES[0], _TABLES[1]


class Letters:
    """Words of a block: trigram buckets of each letter, where each word's letters begin, and each word's place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, lower = _tables()
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        rows = points[offsets]
        is_letter = letter[codes]
        begins = is_letter.copy()
        begins[1:] &= ~is_letter[:-1]
        edge = rows[:-1][rows[:-1] < len(codes)]
        begins[edge] |= is_letter[edge]
        at = np.flatnonzero(is_letter)
        self.begin = np.flatnonzero(begins[at])  # of each word's letters, within ``at``
        start = at[self.begin]
        self.length = np.diff(np.append(self.begin, len(at)))
        self.first = np.searchsorted(start, rows)  # of each row's words
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.start = start - rows[row]  # code points of the text
        c = lower[codes[at]].astype(np.uint32)
        before, after = np.zeros(len(c), np.uint32), np.zeros(len(c), np.uint32)
        before[1:], after[:-1] = c[:-1], c[1:]
        before[self.begin] = 0
        after[self.begin[1:] - 1] = 0
        self.bucket = ((before * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
        self.script = _SCRIPTS[np.searchsorted(_STARTS, codes[start], "right") - 1]


class Model:
    """``languages`` ascending, log probabilities (language, bucket), candidates (script, language)."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        self.log = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)
        can = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= SCRIPT_SHARE).T
        self.narrow = np.where(can, np.float32(0), _FAR)
        self.known = can.any(1)

    def words(self, t: Letters) -> np.ndarray:
        """(words, languages) scores."""
        if not len(t.begin):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.stack([np.add.reduceat(row[t.bucket], t.begin) for row in self.log], 1)
        out -= out.max(1, keepdims=True)
        return np.where(self.known[t.script][:, None], out + self.narrow[t.script], np.float32(0))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; ``first``: where each row's words begin, n + 1 of them.

    A word whose best language leads by more than a switch there and back has it on every best path.  Rows are cut
    behind such words and the pieces go on side by side, so steps follow the longest piece and not the longest text.
    """
    top = np.sort(scores, 1)
    sure = top[:, -1] - top[:, -2] > 2 * penalty if scores.shape[1] > 1 else np.ones(len(scores), bool)
    starts = np.union1d(first, np.flatnonzero(sure) + 1)
    count = np.diff(starts)
    order = np.argsort(-count, kind="stable")
    begin, active = starts[:-1][order], count[order]
    known = scores.argmax(1)[begin - 1]  # of the sure word before a piece, if it isn't a row's first
    change = ~np.isin(begin, first)[:, None] & (known[:, None] != np.arange(scores.shape[1]))
    here = np.searchsorted(-active, -np.arange(int(count.max(initial=0))), "left")  # rows that have a word t
    switched, best_before = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int64)
    out, state = np.zeros(len(scores), np.int64), np.zeros((len(order), scores.shape[1]), np.float32)
    for t, n in enumerate(here):
        at = begin[:n] + t
        if t:
            now = state[:n]
            best = now.argmax(1)
            moved = now[np.arange(n), best] - np.float32(penalty)
            switched[at] = moved[:, None] > now
            best_before[at] = best
            state[:n] = np.maximum(now, moved[:, None]) + scores[at]
            state[:n] -= state[:n].max(1, keepdims=True)
        else:
            state[:n] = scores[at] - np.float32(penalty) * change
    last = state.argmax(1)
    for t in range(len(here) - 1, -1, -1):
        n = here[t]
        at = begin[:n] + t
        out[at] = last[:n]
        last[:n] = np.where(switched[at, last[:n]], best_before[at], last[:n])
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """None without labelled rows.  ``labels``: doc_id, label."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in W.blocks(batch.column("text")):
            t = Letters(data, offsets)
            edge = np.append(t.begin, len(t.bucket))
            at, n, scripts = [], [], []
            for a, b in zip(t.first[:-1], t.first[1:], strict=True):
                which, times = np.unique(t.bucket[edge[a] : edge[b]], return_counts=True)
                at.append(which.astype("<u2").tobytes())
                n.append(times.astype("<u4").tobytes())
                scripts.append(np.bincount(t.script[a:b], t.length[a:b], N_SCRIPTS).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), *(pa.array(x, pa.binary()) for x in (at, n, scripts))], ["doc_id", "label", "at", "n", "scripts"])

    rows = S.map_arrow(labelled(docs, labels, sample), step, "doc_id bigint, label string, at binary, n binary, scripts binary").dropDuplicates(["doc_id"]).limit(sample).collect()
    if not rows:
        return None
    languages = sorted({r.label for r in rows})
    counts, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), N_SCRIPTS))
    for r in rows:
        i = languages.index(r.label)
        counts[i, np.frombuffer(r.at, "<u2")] += np.frombuffer(r.n, "<u4")
        scripts[i] += np.frombuffer(r.scripts, "<u4")
    return Model(languages, counts, scripts)


def label_block(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float) -> tuple[list[str], list[float], list[str]]:
    """Language, share of its letters and spans (start:end:language, code points) of each text of a block."""
    t = Letters(data, offsets)
    path, n, k = viterbi(model.words(t), t.first, penalty), len(offsets) - 1, len(model.languages)
    row = np.repeat(np.arange(n), np.diff(t.first))
    letters = np.bincount(row * k + path, t.length, n * k).reshape(n, k)
    total = letters.sum(1)
    best = letters.argmax(1)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(path)) - 1 if len(a) else a
    texts = [f"{s}:{e}:{model.languages[p]}" for s, e, p in zip(t.start[a], t.start[z] + t.length[z], path[a], strict=True)]
    cut = np.searchsorted(a, t.first)
    return (
        [model.languages[b] if x else "und" for b, x in zip(best, total, strict=True)],
        [float(letters[i, best[i]] / x) if x else 0.0 for i, x in enumerate(total)],
        [",".join(texts[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)],
    )


def identify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of every row; one pass without a shuffle.  ``labels``: where ``lang_col`` is, ``docs`` if not given."""
    own = S.documents(docs, id_col, text_col)
    known = (docs if labels is None else labels).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own, known, sample))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, shares, spans = [], [], []
        for _, _, data, offsets in W.blocks(batch.column("text"), 2 * W.BLOCK):
            n = len(offsets) - 1
            found = label_block(model.value, data, offsets, penalty) if model.value else (["und"] * n, [0.0] * n, [""] * n)
            for out, more in zip((names, shares, spans), found, strict=True):
                out += more
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(shares, pa.float64()), pa.array(spans)], ["doc_id", "lang_pred", "score", "spans"])

    return S.map_arrow(own, step, "doc_id bigint, lang_pred string, score double, spans string").select("doc_id", S.held_out().alias("held_out"), "lang_pred", "score", "spans")
