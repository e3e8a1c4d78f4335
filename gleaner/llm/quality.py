"""Quality classifier: similarity-weighted votes of nearest labelled neighbours in a latent-semantic space.

A text is counted by hashed byte trigrams and word shapes, weighted by log count and inverse document frequency,
and projected on the leading right singular vectors of the labelled sample.  The sample's vectors are broadcast:
at most ``SAMPLE`` x ``RANK`` numbers, whatever the input.  Each partition computes exact cosine products of its
documents, block by block, with all of them; the ``NEIGHBOURS`` nearest vote with a power of their cosine.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2; labels, language, source and id
are no features.  Defined results: a null or empty text, or one without terms, has no direction, so the ``NEIGHBOURS``
labelled texts of fewest terms vote, and those that have as few as the last of these; a text without any positive
cosine gets the sample's mean label; without labelled rows every score is 0.5; repeated labels of an id count by their least; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W
from ._sample import labelled

#: Labelled rows that the space is fitted on and that vote.
SAMPLE = 4096
RANK = 64
NEIGHBOURS = 25
#: Of a cosine in a vote.
POWER = 8
TRIGRAMS, SHAPES = 4096, 256
TERMS = TRIGRAMS + SHAPES

_KIND = np.zeros(256, np.int64)  # 1 lower, 2 upper, 4 digit, 8 symbol, 16 other punctuation
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 4
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 16
_KIND[list(b"#*$%&|<>@^~_=+\\")] = 8
_KIND[128:] = 1


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, TERMS) counts of byte trigrams and word shapes."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    cells = [np.zeros(0, np.int64)]
    if len(data) > 2:
        d = data.astype(np.uint32)
        h = ((d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
        same = rows[:-2] == rows[2:]
        cells.append((rows[:-2] * TERMS + (h >> np.uint32(20)))[same])
    words = W.split(data, offsets)
    if len(words.start):
        # each word weighs as much as the trigrams of a short word
        kinds = _KIND[data]
        shape = np.bitwise_or.reduceat(np.append(kinds, 0), np.stack([words.start, words.end], 1).ravel())[::2]
        first, last = kinds[words.start], kinds[words.end - 1]
        again = np.zeros(len(words.start), np.int64)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
        code = (shape * 7 + first * 31 + last * 61) % (SHAPES // 2) + again * (SHAPES // 2)
        cells.append(words.row * TERMS + TRIGRAMS + code)
    return np.bincount(np.concatenate(cells), minlength=n * TERMS).reshape(n, TERMS)


class Space:
    """Fitted on (rows, TERMS) counts and their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = self._weighed(counts)
        rng = np.random.default_rng(0)
        rank = min(rank, *x.shape)
        q = x.T @ (x @ rng.standard_normal((x.shape[1], min(rank + 10, x.shape[1])), dtype=np.float32))
        for _ in range(4):  # randomised subspace iteration
            q = x.T @ (x @ np.linalg.qr(q)[0])
        q = np.linalg.qr(q)[0]
        self.axes = (q @ np.linalg.svd(x @ q, full_matrices=False)[2][:rank].T).astype(np.float32)
        self.vectors, self.labels, self.mean = self._unit(x @ self.axes), labels.astype(np.float32), float(labels.mean())
        size = counts.sum(1)
        self.briefest = float(labels[size <= np.sort(size)[min(NEIGHBOURS, len(size)) - 1]].mean())

    def _weighed(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts).astype(np.float32) * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        cosine = self._unit(self._weighed(counts) @ self.axes) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER
        total = weight.sum(1)
        votes = np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.mean)
        return np.where(counts.sum(1) == 0, self.briefest, votes).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space | None:
    """None without labelled rows.  ``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1).  At most ``sample`` rows come to the driver."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in W.blocks(batch.column("text")):
            counts = terms(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array([np.flatnonzero(r).astype("<u2").tobytes() for r in counts]), pa.array([r[r > 0].astype("<u4").tobytes() for r in counts])], ["doc_id", "label", "at", "n"])

    chosen = labelled(docs, labels, sample)
    rows = S.map_arrow(chosen, step, "doc_id bigint, label double, at binary, n binary").dropDuplicates(["doc_id"]).limit(sample).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.doc_id)
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.n, "<u4")
    return Space(counts, np.array([r.label for r in rows]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of every row; one pass without a shuffle."""
    own = S.documents(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(own, labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("double").alias("label")), sample))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        space, out = model.value, []
        for _, _, data, offsets in W.blocks(batch.column("text")):
            out.append(np.full(len(offsets) - 1, 0.5) if space is None else space.scores(terms(data, offsets)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    scored = S.map_arrow(own, step, "doc_id bigint, score double")
    predicted: Column = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", S.held_out().alias("held_out"), "score", predicted.alias("predicted"))


def predicate(spark, space: Space | None, threshold: float = 0.7):
    """A column function of texts: whether they score ``threshold`` or more; without a fitted space all do."""
    model = spark.sparkContext.broadcast(space)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        if model.value is None:
            return pd.Series(True, index=texts.index)
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        scores = [model.value.scores(terms(data, offsets)) for _, _, data, offsets in W.blocks(column)]
        return pd.Series(np.concatenate(scores) >= threshold if scores else np.zeros(0, bool))

    return passes
