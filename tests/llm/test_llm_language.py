"""Language: held-out accuracy, mixed texts, and Viterbi against all sequences."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_tools import plain
from pyspark.sql import functions as F

from gleaner.llm import _words as W
from gleaner.llm import language
from gleaner.llm.queries import op8_language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in op8_language(spark, SF).collect()}


def test_held_out_accuracy(rows, found):
    assert found.keys() == rows.keys()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    held = [(r.lang_pred, rows[d].lang) for d, r in found.items() if r.held_out and rows[d].lang]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_held_out_languages_are_not_learned(spark, found):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(turned).collect()} == {d: (r.lang_pred, r.score) for d, r in found.items()}


def test_mixed_text(spark, rows, found):
    pure = {lang: next(r.text for r in rows.values() if r.lang == lang and found[r.doc_id].score == 1 and 300 < len(r.text) < 2500) for lang in ("en", "de")}
    mixed = f"{pure['en']}\n{pure['de']}\n1234 !!"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = language.identify(docs.select("doc_id", "text").unionByName(plain(spark, {-1: mixed, -2: "123 !?"})), docs).where("doc_id = -1").first()
    spans = [x.split(":") for x in r.spans.split(",")]
    assert [s[2] for s in spans] == ["en", "de"]
    assert abs(int(spans[1][0]) - len(pure["en"])) < 40


def test_scripts_narrow(spark):
    learned = {"ru": "привет мир как дела у вас сегодня", "en": "hello world how are you all today", "el": "γειά σου κόσμε"}
    free = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = dict(zip(free, learned.values(), strict=False))
    labels = spark.createDataFrame(list(zip(free, learned, strict=False)), "doc_id bigint, lang string")
    asked = {100: "дела", 101: "ελλάδα", 102: "today", 103: "漢字", 104: "77"}
    got = {r.doc_id: r.lang_pred for r in language.identify(plain(spark, texts | asked), labels).collect()}
    assert [got[i] for i in (100, 101, 102, 104)] == ["ru", "el", "en", "und"] and got[103] in learned


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    for lengths in ([3, 0, 5, 1], [6], [0], [2, 2, 2]):
        first = np.concatenate([[0], np.cumsum(lengths)])
        scores = -rng.exponential(4, (first[-1], 3)).astype(np.float32)
        path = language.viterbi(scores, first, 3.0)
        for a, b in zip(first[:-1], first[1:], strict=True):
            value = lambda p, s=scores[a:b]: sum(s[i, x] for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            best = max(map(value, itertools.product(range(3), repeat=b - a)))
            assert value(path[a:b]) == pytest.approx(best, abs=1e-3)


def test_words_are_runs_of_letters():
    texts = ["Don't stop-me 3x é1ü", "", "日本語 \U0001f600a", "x", "y"]
    data, offsets = W.flat(pa.array(texts))
    t = language.Letters(data, offsets)
    found = [[texts[i][s : s + n] for s, n in zip(t.start[a:b], t.length[a:b], strict=True)] for i, (a, b) in enumerate(zip(t.first[:-1], t.first[1:], strict=True))]
    assert found == [["Don", "t", "stop", "me", "x", "é", "ü"], [], ["日本語", "a"], ["x"], ["y"]]


def test_cut_rows_lose_nothing():
    """Long rows with sure words, whose pieces are decoded side by side, score as a plain program over the whole row does."""
    rng = np.random.default_rng(5)
    penalty, first = 2.5, np.array([0, 0, 1200, 1201, 3000])
    scores = (rng.normal(size=(3000, 4)) * 2.5).astype(np.float32)
    top = np.sort(scores, 1)
    assert 50 < (top[:, -1] - top[:, -2] > 2 * penalty).sum() < 1500
    path = language.viterbi(scores, first, penalty)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        got = scores[np.arange(a, b), path[a:b]].astype(float).sum() - penalty * (np.diff(path[a:b]) != 0).sum()
        state = scores[a].astype(float)
        for t in range(a + 1, b):
            state = np.maximum(state, state.max() - penalty) + scores[t]
        assert got == pytest.approx(state.max(), abs=1e-3)
