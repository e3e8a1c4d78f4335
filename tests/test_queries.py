"""Every core query that has SQL matches it; the others return rows."""

import pytest
from compare import same

from gleaner.plans import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    same(spark, core.queries()[name], SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_returns_rows(spark, sf, name):
    assert core.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_training_runs_in_full_and_scores_every_document(spark, tmp_path, monkeypatch):
    from gleaner.operators import training
    from gleaner.plans import queries

    seen = []
    fit = training.train_on
    monkeypatch.setattr(training, "train_on", lambda *a, **b: seen.append(b.get("iterations", training.ITERATIONS)) or fit(*a, **b))
    texts = [(1, "good words here"), (2, "bad words there"), (3, ""), (4, "unseen")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.topic, r.doc_id): r.score for r in queries.train_sgd_scores(spark, str(tmp_path)).collect()}
    assert seen == [200_000]
    assert got.keys() == {(t, d) for t in ("quality", "toxic") for d in (1, 2, 3, 4)}
    assert got["quality", 1] > 0 > got["quality", 2] and got["quality", 3] == got["quality", 4] == 0
