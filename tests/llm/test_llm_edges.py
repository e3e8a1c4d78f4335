"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

from collections import Counter

import pytest
from llm_tools import CLASHES, LONG, ROWS, documents
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, language, licenses, lm, neardup, packing, quality, rules, secrets, stages, urls
from gleaner.llm.queries import bpe_path

IDS = Counter(r[0] for r in ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(None, 1, 0, 0.0), (4, None, 0, 0.0), (5, 1, 0, 0.0), (5, 0, 1, 0.0), (7, 1, 0, 0.0), (99, 0, 0, 0.0), (8, 0, None, 0.0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, score double")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(None, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6 and6 word7 and7", "k"), (1, None, "k"), (2, "", "k"), (3, "the same text stands here", "k"), (3, "the same text stands here", "k")]
    return spark.createDataFrame(rows, "item_id bigint, text string, key string")


def ids(df, column="doc_id"):
    return Counter(r[0] for r in df.select(column).collect())


def test_secrets(docs, empty):
    got = secrets.scan(docs).collect()
    assert Counter(r.doc_id for r in got) == IDS
    assert all(r.n_assign == 0 and r.spans == "" for r in got if r.doc_id in (1, 2))
    assert secrets.scan(empty).collect() == []
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns
    assert sorted(map(str, masked.collect())) == sorted(map(str, docs.collect()))


def test_quality(docs, empty, labels):
    got = quality.score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == IDS and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert all(r.score == 0.5 and r.predicted == 0 for r in quality.score(docs, labels.where("false")).collect())
    assert quality.score(empty, labels).collect() == []


def test_decontamination(docs, empty, items):
    got = decontaminate.overlaps(docs, items)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == {(5, 3), (6, 3), (7, None)}
    assert got.where("doc_id = 5").count() == 4  # each row of the document with each row of the item
    assert decontaminate.overlaps(empty, items).count() == 0 == decontaminate.overlaps(docs, items.where("false")).count()
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and ids(left) == IDS - Counter({5: 2, 6: 1, 7: 1})
    assert ids(decontaminate.clean(docs, items.where("false"))) == IDS


def test_lm(docs, empty):
    got = lm.score(docs).collect()
    assert Counter(r.doc_id for r in got) == IDS
    assert {(r.doc_id, r.n_words) for r in got} >= {(1, 0), (2, 0), (3, 0), (4, 1), (7, len(LONG.split()))}
    assert all(r.mean_log_score is None and r.log_score == 0 for r in got if r.n_words == 0)
    assert len({r.log_score for r in got if r.doc_id in (5, 6)}) == 1
    assert lm.score(empty).collect() == []


def test_packing(docs, empty):
    got = packing.pack(docs, bpe_path()).collect()
    assert set(r.doc_id for r in got) == set(IDS)
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id in (1, 2)] == [(1, 1)] * 2
    assert packing.pack(empty, bpe_path()).collect() == []


def test_licenses(docs, empty):
    paths = docs.withColumn("path", F.when(F.col("doc_id") != 6, F.concat_ws("/", "source", F.col("doc_id"))))
    assert ids(licenses.scan(paths)) == IDS
    assert licenses.scan(empty.withColumn("path", F.lit("x"))).collect() == []


def test_urls(spark):
    rows = [(None, "http://A.example/x", None), (1, None, "<a href='http://b.example'>"), (2, "no scheme", ""), (3, "", "x"), (4, "http://", "x"), (4, "http://", "x")]
    pages = spark.createDataFrame([(*r, "h", "r", 1.0, 2) for r in rows], "page_id bigint, url string, html string, host string, rule string, trust double, src bigint")
    got = urls.judge(pages, ["block a.example/"]).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted([(None, "a.example", "/x", "a.example/", "block"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (4, "", "", None, "allow")], key=str)
    assert urls.judge(pages.where("false"), ["block a.example/"]).collect() == []
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_language(docs, empty):
    got = language.identify(docs).collect()
    assert Counter(r.doc_id for r in got) == IDS
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, -9))
    assert all(r.lang_pred in ("en", "fr") for r in got if r.doc_id in (4, 5, 6, 7, 8))
    assert language.identify(empty).collect() == []
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_rules(docs, empty):
    got = rules.judge(docs).collect()
    assert Counter(r.doc_id for r in got) == IDS
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 10)
    assert {r.n_words for r in got if r.doc_id == 7} == {len(LONG.split())}
    assert rules.judge(empty).collect() == []


def test_near_duplicates(docs, empty):
    got = neardup.near_duplicates(docs)
    assert ids(got) == IDS
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 10, 5, True), (6, 10, 5, False)} <= rows
    assert {(r[0], r[2], r[3]) for r in rows if r[0] is None} == {(None, None, True)}
    assert neardup.near_duplicates(empty).collect() == []


def test_stages_keep_columns_and_clean_rows(spark, docs, empty, sf):
    for _, stage in (("quality", stages.keep_quality), ("near", stages.drop_near_duplicates), ("decontamination", stages.drop_contaminated), ("secrets", stages.mask_secrets)):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, empty, sf).count() == 0
    kept = ids(stages.drop_near_duplicates(spark, docs, sf))
    assert kept == Counter({i: 1 for i in IDS if i != 6})
    assert len(CLASHES.split(", ")) + 5 == len(docs.columns)
