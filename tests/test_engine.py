"""Collections, readers, scoring invariants, training and the loop."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import tokens
from gleaner.operators import index, review, scoring, training
from gleaner.sources import files
from gleaner.sources.collection import Collection
from gleaner.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def tf(docs):
    return index.term_frequencies(docs).cache()


@pytest.fixture(scope="module")
def judged(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("rel"))


def test_collection(spark, docs, tmp_path):
    extra = spark.createDataFrame([(10**6, "")], "doc_id bigint, text string")
    c = Collection.build(docs.select("doc_id", "text").unionByName(extra), str(tmp_path / "c"))
    n = docs.count() + 1
    assert c.stats.first().num_docs == n == c.docmap.count()
    assert sorted(r.tok_id for r in c.vocab.collect()) == list(range(1, c.stats.first().num_features + 1))
    assert c.vocab.orderBy("token").agg(F.max("tok_id")).first()[0] == c.stats.first().num_features
    empty = c.document_int(str(10**6))
    assert c.feature_vector(empty).count() == 0 and c.document_id(empty) == str(10**6)
    assert c.feature_vectors().where(F.size("features") == 0).count() == 1
    word = c.vocab.first()
    assert c.token_id(word.token) == word.tok_id and c.token_id("no such token") is None
    assert c.posting_list(word.tok_id).count() > 0
    model = spark.createDataFrame([("t", word.token, 1.5), ("t", "x", 0.0)], "topic string, token string, w double")
    c.save_model(model, "m")
    assert [(r.token, r.w) for r in Collection.open(spark, c.path).model("m").collect()] == [(word.token, 1.5)]
    with pytest.raises(ValueError):
        Collection.build(docs.unionByName(docs), str(tmp_path / "d"))


def test_readers(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "body": f"text {i}", "more": 1}) for i in range(3)]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    got = files.json_documents(spark, str(tmp_path / "a.jsonl.gz"), "id", "body").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(str(i), f"text {i}") for i in range(3)]
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="no body"):
        files.json_documents(spark, str(tmp_path / "b.jsonl"), "id", "body").collect()
    (tmp_path / "q").write_text("# note 0 x 1\nt1 0 d1 1\nt1  0\td2 0\nt2 0 d1 2\n")
    assert sorted(map(tuple, files.qrels(spark, str(tmp_path / "q")).collect())) == [("t1", "d1", 1), ("t1", "d2", 0), ("t2", "d1", 2)]
    assert sorted(r.doc_id for r in files.excludes(spark, str(tmp_path / "q")).collect()) == ["0", "d1", "d2"]
    (tmp_path / "p").write_text("t1 d1 1 run x\nt1 d2 20 run\nt2 d3 1 run\n")
    assert [r.doc_id for r in files.pool(spark, str(tmp_path / "p"), "t1", 10).collect()] == ["d1"]
    rows = spark.createDataFrame([("t", "d", 0, 1), ("t", "d", 2, 5), ("u", "d", 9, 7)], "topic string, doc_id string, rel int, line_no int")
    assert [tuple(r) for r in files.last_judgments(rows, "t").collect()] == [("d", 2)]


def test_scan_and_index_agree(docs, tf, judged):
    model = scoring.centroid_model(tf, judged).cache()
    by_index = {r.doc_id: r.score for r in scoring.by_index(tf, model).collect()}
    by_scan = {r.doc_id: r.score for r in scoring.by_scan(docs, tf, model).collect()}
    assert set(by_scan) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {d: s for d, s in by_scan.items() if d in by_index} == by_index
    assert all(s == 0 for d, s in by_scan.items() if d not in by_index)
    best = scoring.top(scoring.by_index(tf, model, judged), 5).collect()
    assert [r["rank"] for r in best] == [1, 2, 3, 4, 5] and best == sorted(best, key=lambda r: (-r.score, r.doc_id))
    with pytest.raises(ValueError):
        scoring.check_known(judged.sparkSession.createDataFrame([(-1,)], "doc_id bigint"), docs)


def test_report(spark):
    rows = spark.createDataFrame([("pos", 1.0), ("pos", 0.0), ("neg", 0.0), ("neg", -1.0)], "part string, score double")
    assert tuple(training.report(rows).first()) == (1, 1, 1, 0.5, 0.5)
    nothing = training.report(rows.where("false")).first()
    assert np.isnan(nothing.precision) and np.isnan(nothing.recall)


def test_descent_separates():
    rng = np.random.default_rng(3)
    make = lambda lo: [(np.unique(rng.integers(lo, lo + 30, 8)),) for _ in range(20)]
    pos, neg = ([(i, np.ones(len(i))) for (i,) in make(lo)] for lo in (0, 20))
    w = training.descend(pos, neg, 60, iterations=4000)
    score = lambda part: np.array([w[i] @ v for i, v in part])
    assert (score(pos)[:, None] > score(neg)[None]).mean() > 0.97
    assert np.isfinite(w).all()
    with pytest.raises(ValueError):
        training.descend([], neg, 60)


def test_train_topics(tf, judged):
    qrels = judged.select(F.lit("q").alias("topic"), "doc_id", "rel")
    a, b = (training.train_on(tf, qrels, iterations=500).orderBy("token").collect() for _ in range(2))
    assert a == b and len(a) > 100


def test_loop(docs, tf, judged):
    pool = docs.orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id").withColumn("rank", F.lit(1))
    done = review.run(tf, pool, judged, per_step=5, stop=review.Stop(found_all=False, max_steps=2), trainer=review.sgd_trainer(iterations=300))
    rows = done.judgments.collect()
    assert done.reason == "maximum steps" and len({r.doc_id for r in rows}) == len(rows) == 30
    curve = review.curve(done.judgments).orderBy("step").collect()
    assert [r.reviewed for r in curve] == [20, 25, 30]
    assert review.average_precision(review.curve(done.judgments), 0).first().ap is None
    again = review.already_judged(scoring.by_index(tf, done.model, done.judgments), done.judgments)
    assert again.isEmpty()


def test_loop_by_scan(spark):
    """Scan scoring also offers documents without any weighted token."""
    tf = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "a", 2)], "doc_id bigint, token string, tf bigint")
    docs = spark.range(1, 6).withColumnRenamed("id", "doc_id")
    qrels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id bigint, rel int")
    pool = spark.createDataFrame([(1, 1), (2, 2)], "doc_id bigint, rank int")
    options = {"per_step": 5, "stop": review.Stop(found_all=False, max_steps=1), "trainer": scoring.centroid_model}
    assert {r.doc_id for r in review.run(tf, pool, qrels, **options).judgments.collect()} == {1, 2, 3}
    assert {r.doc_id for r in review.run(tf, pool, qrels, scan=docs, **options).judgments.collect()} == {1, 2, 3, 4, 5}


def test_topics_together_equal_topics_alone(spark, docs, tf, judged):
    """Each topic ends as it does on its own: judgments, model, reason and step."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    qrels = judged.select(F.lit("quality").alias("topic"), "doc_id", "rel").unionByName(labels.select(F.lit("toxic").alias("topic"), "doc_id", F.col("toxic").alias("rel")))
    few = spark.createDataFrame([("few", 1, 1), ("few", 2, 0)], "topic string, doc_id bigint, rel int")
    qrels = qrels.unionByName(few)
    pool = qrels.where("rel > 0").groupBy("topic").agg(F.min("doc_id").alias("doc_id"), F.lit(1).alias("rank")).unionByName(docs.where("doc_id IN (2, 5, 8)").crossJoin(qrels.select("topic").distinct()).select("topic", "doc_id", F.lit(2).alias("rank"))).dropDuplicates(["topic", "doc_id"]).cache()
    options = {"per_step": 4, "stop": review.Stop(max_steps=3)}
    every = review.run_topics(tf, pool, qrels, trainer=scoring.centroid_models, **options)
    assert every.reasons == {"few": "all relevant found", "quality": "maximum steps", "toxic": "maximum steps"} and every.steps["few"] == 1
    for t in every.reasons:
        alone = review.run(tf, pool.where(F.col("topic") == t), qrels.where(F.col("topic") == t), trainer=scoring.centroid_model, **options)
        mine = lambda df: df.where(F.col("topic") == t).drop("topic")  # noqa: B023, E731
        assert (every.reasons[t], every.steps[t]) == (alone.reason, alone.steps)
        for got, want in ((every.judgments, alone.judgments), (every.models, alone.model)):
            assert sorted(map(tuple, mine(got).collect())) == sorted(map(tuple, want.collect()))


def test_topics_by_descent(tf, judged, docs):
    """The default trainer takes all topics at once; a topic of one side has no model and ends."""
    qrels = judged.select(F.lit("quality").alias("topic"), "doc_id", "rel").unionByName(judged.select(F.lit("none").alias("topic"), "doc_id", F.lit(0).alias("rel")))
    pool = qrels.select("topic", "doc_id", F.lit(1).alias("rank"))
    done = review.run_topics(tf, pool, qrels, per_step=5, stop=review.Stop(found_all=False, max_steps=1), trainer=lambda *a: training.train_on(*a, iterations=300))
    assert done.reasons == {"quality": "maximum steps", "none": "maximum steps"}
    assert {r.topic for r in done.models.select("topic").distinct().collect()} == {"quality"}
    assert done.judgments.where("step = 1 AND topic = 'quality'").count() == 5


@pytest.mark.parametrize(("rule", "state", "reason"), [({}, (1, 10, 5, 5, 1, 0), "all relevant found"), ({"max_steps": 3}, (3, 10, 1, 5, 0, 0), "maximum steps"), ({"fail_out": True}, (1, 301, 200, 500, 5, 0), "many relevant after 300 documents"), ({"fail_out": True}, (1, 151, 20, 500, 2, 0), "few relevant after 150 documents"), ({"zero_steps": 2}, (9, 10, 1, 5, 0, 3), "no relevant in recent steps"), ({}, (1, 10, 1, 5, 0, 9), None)])
def test_stop_rules(rule, state, reason):
    assert review.Stop(**rule).reason(*state) == reason


def test_external_sort(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(int, r)) for r in rng.integers(0, 500, (10_000, 3))]
    got = [tuple(r) for r in index.sorted_tuples(spark.createDataFrame(rows, "tok_id bigint, doc_int bigint, tf bigint")).collect()]
    assert got == sorted(rows)


def test_stream(spark, docs, tf, judged, tmp_path):
    source = str(tmp_path / "in")
    docs.select("doc_id", "text").repartition(3).write.parquet(source)
    model = scoring.centroid_model(tf, judged)
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(source)
    q = score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.doc_id: r.score for r in scoring.by_scan(docs, tf, model).collect()}


def test_plans(spark, docs, tf, judged):
    model = scoring.centroid_model(tf, judged)
    plan = scoring.by_index(tf, model, judged).orderBy(F.desc("score")).limit(5)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "TakeOrderedAndProject" in plan and "Cartesian" not in plan


def test_lists_in_segments(spark, monkeypatch):
    """Gaps and sizes don't depend on how a list is cut."""
    rng = np.random.default_rng(2)
    lists = {t: sorted(rng.choice(np.arange(1, 200), n, replace=False).tolist()) for t, n in ((1, 150), (2, 1), (3, 20))}
    rows = [(t, d, int(rng.integers(1, 9))) for t, ds in lists.items() for d in ds]
    e = spark.createDataFrame(rows, "tok_id bigint, doc_int bigint, tf bigint")
    want, sizes = sorted(map(tuple, index.gaps(e).collect())), sorted(map(tuple, index.posting_bytes(e).collect()))
    assert [(t, d, g) for t, d, g, _ in want] == [(t, d, d - b) for t, ds in lists.items() for b, d in zip([0, *ds], ds, strict=False)]
    monkeypatch.setattr(index, "SEGMENT", 10)
    assert sorted(map(tuple, index.gaps(e).collect())) == want and sorted(map(tuple, index.posting_bytes(e).collect())) == sizes
    cut = index.posting_lists(e).collect()
    assert max(len(r.postings) for r in cut) <= 10 and sum(r.df for r in cut) == len(rows)
    assert sorted((r.tok_id, p.doc_int, p.tf) for r in cut for p in r.postings) == sorted(rows)


def test_bounded_training(spark):
    judged = spark.createDataFrame([("t", i, "pos" if i % 4 else "neg") for i in range(4000)], "topic string, doc_id bigint, part string")
    assert training.bounded(judged, 4000).count() == 4000
    n = {r.part: r["count"] for r in training.bounded(judged, 500).groupBy("part").count().collect()}
    assert all(400 < x < 600 for x in n.values())


def test_start_from_a_model(tf, judged):
    qrels = judged.select(F.lit("q").alias("topic"), "doc_id", "rel")
    model = training.train_on(tf, qrels, iterations=300)
    again = training.train_on(tf, qrels, iterations=300, initial=model)
    assert again.count() > 100 and again.where("w = 0 OR isnan(w)").isEmpty()


@pytest.mark.parametrize("root_norms", [False, True])
def test_descent_equals_a_plain_loop(root_norms):
    """Dense vectors, each step written out: shrink, add the pair's gain, project."""
    rng, lam, size = np.random.default_rng(3), 1e-3, 30
    sides = [[(np.sort(rng.choice(size, 6, replace=False)), rng.integers(1, 5, 6).astype(float)) for _ in range(9)] for _ in range(2)]
    first = rng.normal(size=size)
    got = training.descend(*sides, size, iterations=500, lam=lam, seed=4, initial=first, root_norms=root_norms)
    draw = np.random.default_rng(4)
    picks = [draw.integers(9, size=500), draw.integers(9, size=500)]
    dense = [[np.bincount(at, v, size) for at, v in side] for side in sides]
    w, square = first, 0.0
    for t in range(1, 501):
        p, n = dense[0][picks[0][t - 1]], dense[1][picks[1][t - 1]]
        gain = 1 / (lam * t) / (1 + np.exp(min(w @ (p - n), 700)))
        w = w * (t - 1) / t
        norm = np.linalg.norm if root_norms else lambda v: v @ v
        square = square * ((t - 1) / t) ** 2 + 2 * gain * (w @ (p - n)) + gain**2 * (norm(p) + norm(n) - 2 * p @ n)
        w = w + gain * (p - n)
        if square > 1 / lam:
            w, square = w * np.sqrt(1 / lam / square), 1 / lam
    np.testing.assert_allclose(got, w, rtol=1e-8, atol=1e-8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]


def test_postings_are_neither_shuffled_by_document_nor_sorted_by_token(spark, docs, monkeypatch):
    from gleaner import session

    monkeypatch.setattr(session.small, "__defaults__", (1,))
    monkeypatch.setattr(session.looked_up, "__defaults__", (1,))  # dictionaries too large to be broadcast
    ids = index.docmap(docs)
    tf = index.numbered_frequencies(session.placed(docs.select("doc_id", "text"), "doc_id"), ids)
    assert plan(tf).count("Exchange") == 2 and "SortMergeJoin" not in plan(tf)  # of the texts and of the numbers
    want = index.term_frequencies(docs).join(ids, "doc_id")
    assert sorted(tf.collect()) == sorted(want.select(tf.columns).collect())
    kept = session.stored(tf)
    encoded = index.encoded(kept, index.vocabulary(kept))
    assert "ShuffledHashJoin" in plan(encoded) and "Sort " not in plan(encoded)


def test_gaps_over_segments(spark, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 4)
    lists = {1: [1, 2, 3, 4, 5, 9, 30], 2: [6], 3: [2, 17, 18], 4: [4, 5]}
    rows = [(k, d, 1 + (k + d) % 3) for k, v in lists.items() for d in v]
    got = index.gaps(spark.createDataFrame(rows, "tok_id bigint, doc_int bigint, tf bigint"))
    want = [(k, d, d - p, 1 + (k + d) % 3) for k, v in lists.items() for p, d in zip([0, *v], v, strict=False)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert plan(got).count("Exchange") <= 3  # the rows once, and the ends of segments


def test_stored_tables_go_with_the_session(spark, docs):
    from gleaner import session

    got = session.stored(docs.select("doc_id"))
    assert got.count() == docs.count() and "parquet" in plan(got).lower()


def test_numbers_of_many_partitions(spark):
    got = index.numbered(spark.range(1000).repartitionByRange(50, "id").sortWithinPartitions("id"), "n")
    assert all(r.n == r.id + 1 for r in got.collect()) and got.count() == 1000
    assert "map(" not in plan(got)


def test_a_collection_weighs_lists_by_number(spark, docs, judged, tmp_path):
    from gleaner.functions import tokens

    c = Collection.build(docs, str(tmp_path / "w"), tokens.words)
    mine = judged.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(spark.createDataFrame([("none", 1)], "doc_id string, rel int"))
    assert sorted(c.centroid_model(mine).collect()) == sorted(scoring.centroid_model(c.tf(), mine).collect())


def test_scores_of_several_topics_in_one_pass(spark, docs, tf):
    models = spark.createDataFrame([("a", "the", 1.5), ("b", "the", -2.0), ("b", "of", 0.25), ("c", "of", 9.0), ("a", "in", 0.0)], "topic string, token string, w double")
    got = sorted(map(tuple, scoring.by_topics(docs, tf, models, ("a", "b")).collect()))
    want = [(t, r.doc_id, r.score) for t in ("a", "b") for r in scoring.by_scan(docs, tf, models.where(F.col("topic") == t).drop("topic")).collect()]
    assert got == sorted(want)


def test_stems_are_counted_before_they_are_rows(spark, monkeypatch):
    many = "running runs ran relational " * 40
    texts = [(1, "Running ponies runs"), (2, ""), (3, None), (1, "run 3rds 3RDS"), (None, "nobody's"), (None, "nobody"), (4, "\u00c9t\u00e9s \u65e5\u672c"), (1, "pony"), (5, many), (6, "a b c"), (5, "rate")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    want = {tuple(r) for r in index.term_frequencies(docs, tokens.stemmed_words).collect()}
    assert (1, "run", 3) in want and (1, "poni", 2) in want and (None, "nobodi", 2) in want and (5, "run", 80) in want
    for at_once, records in ((1 << 20, "10000"), (1, "10000"), (5, "10000"), (2, "1")):  # an id's texts in one part, in several, in several batches
        monkeypatch.setattr(index, "WORDS", at_once)
        monkeypatch.setattr(index, "ROWS", at_once)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            got = [tuple(r) for r in index.stemmed_frequencies(docs).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and set(got) == want
    named = docs.selectExpr("concat('d', doc_id) AS name", "text AS body")
    assert {tuple(r) for r in index.stemmed_frequencies(named, "name", "body").collect()} == {(d and f"d{d}", t, n) for d, t, n in want}


def test_stem_tf_shuffles_texts_and_no_words(spark, sf):
    from gleaner.plans import queries

    df = queries.stem_tf(spark, sf)
    assert "Generate" not in plan(df) and "Aggregate" not in plan(df)
    want = index.term_frequencies(queries._docs(spark, sf), tokens.stemmed_words)
    assert sorted(df.collect()) == sorted(want.collect())
