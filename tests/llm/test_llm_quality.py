"""Quality: held-out accuracy, votes against numpy, and what may be learned from."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality, stages
from gleaner.llm.queries import op2_quality_neighbours

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in op2_quality_neighbours(spark, SF).collect()}


def test_held_out(docs, labels, found):
    assert found.keys() == {r.doc_id for r in docs.select("doc_id").collect()}
    for d, r in found.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(found[r.doc_id].score, r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.95


def test_held_out_labels_are_not_learned(docs, labels, found):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(0))
    again = quality.score(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), turned).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({d: r.score for d, r in found.items()})


def test_votes():
    """Exact cosines with all sample vectors, the nearest weighted by a power of theirs."""
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.05, (90, quality.TERMS))
    labels = rng.integers(0, 2, 90)
    space = quality.Space(counts, labels, rank=20)
    asked = np.concatenate([counts[:10], rng.poisson(0.05, (10, quality.TERMS)), np.zeros((1, quality.TERMS), int)])
    got = space.scores(asked, 7)
    for c, s in zip(asked, got, strict=True):
        v = np.log1p(c) * space.idf
        if not v.any():
            size = counts.sum(1)  # nothing to compare: the labelled texts of fewest terms vote
            assert s == pytest.approx(labels[size <= sorted(size)[quality.NEIGHBOURS - 1]].mean())
            continue
        v = v / np.linalg.norm(v) @ space.axes
        cosine = space.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cosine)[:7]
        w = np.maximum(cosine[near], 0) ** quality.POWER
        assert s == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-4)


def test_axes_are_the_leading_ones():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.3, (60, 5)) @ rng.poisson(0.05, (5, quality.TERMS))
    space = quality.Space(counts, np.ones(60), rank=5)
    x = space._weighed(counts)
    best = np.linalg.svd(x, compute_uv=False)[:5]
    assert np.linalg.norm(x @ space.axes) == pytest.approx(np.linalg.norm(best), rel=1e-2)


def test_stage(spark, docs, found):
    """The stage's own verdicts are the query's where it is given the same documents."""
    kept = {r.doc_id for r in stages.keep_quality(spark, docs, SF).select("doc_id").collect()}
    assert kept == {d for d, r in found.items() if r.predicted}
