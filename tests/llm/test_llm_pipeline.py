"""The pipeline's stages in order against the operators' brute-force versions."""

import pytest
from test_llm_decontaminate import brute as overlaps
from test_llm_neardup import brute as near
from test_llm_packing import check
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import secrets, stages
from gleaner.llm.queries import bpe_path, op2_quality_neighbours


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("steps")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append(docs)
    return out


def test_stages_are_those_asked_for():
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.keep_quality, stages.drop_near_duplicates, stages.drop_contaminated, stages.mask_secrets, stages.pack]


def test_each_stage(spark, sf, steps):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(s.columns == source.columns for s in steps[:-1])
    quality, unique, clean, masked = (texts_of(s) for s in steps[:-1])
    all_texts = texts_of(source)
    assert quality == {r.doc_id: all_texts[r.doc_id] for r in op2_quality_neighbours(spark, sf).collect() if r.predicted}
    assert unique == {d: quality[d] for d, (_, c) in near(quality, 5).items() if d == c}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    dropped = unique.keys() - clean.keys()
    assert clean.items() <= unique.items()
    assert {d for d, _ in overlaps({d: unique[d] for d in dropped}, items)} == dropped
    short = dict(sorted(clean.items(), key=lambda x: len(x[1]))[:40])
    assert not overlaps(short, items)
    assert masked == {d: secrets.redact_text(t) for d, t in clean.items()}


def test_packed(spark, sf, steps):
    t = Tokenizer.from_file(bpe_path())
    t.encode_special_tokens = True
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in texts_of(steps[-2]).items()}
    check(steps[-1].collect(), ids, 1024)


def test_run(spark, sf, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) != []
    assert corpus_pipeline.run(spark, sf).agg({"length": "sum"}).first()[0] == steps[-1].agg({"length": "sum"}).first()[0]
