"""Scores of documents by a linear model of tokens.

``model`` has token (or tok_id) and w; zero weights never reach a join.  It is broadcast while it has no more than
``MOST_BROADCAST`` non-zero rows and joined by a shuffle beyond, where AQE splits frequent tokens.
Ties are broken by doc_id ascending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import MOST_BROADCAST, looked_up, small


def _products(tf: DataFrame, model: DataFrame, key: str, doc: str) -> DataFrame:
    return tf.join(looked_up(model.where("w <> 0").select(key, "w")), key).groupBy(doc).agg(F.sum(F.col("w") * F.col("tf")).alias("score"))


def excluded(df: DataFrame, excludes: DataFrame | None, doc: str = "doc_id") -> DataFrame:
    """``df`` without the documents of ``excludes``; unknown ones are ignored."""
    return df if excludes is None else df.join(small(excludes.select(doc).distinct()), doc, "left_anti")


def check_known(excludes: DataFrame, docs: DataFrame, doc: str = "doc_id") -> None:
    """Raises if ``excludes`` has a document that isn't in ``docs``."""
    missing = excludes.select(doc).join(docs.select(doc), doc, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"unknown document {missing[0][0]!r}")


def by_index(tf: DataFrame, model: DataFrame, excludes: DataFrame | None = None, key: str = "token", doc: str = "doc_id") -> DataFrame:
    """(doc_id, score) of the documents that have a weighted token."""
    return excluded(_products(tf, model, key, doc), excludes, doc)  # a row a document, not one a term, meets the excludes


def by_scan(docs: DataFrame, tf: DataFrame, model: DataFrame, excludes: DataFrame | None = None, key: str = "token", doc: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every document; without a weighted token it is 0."""
    every = excluded(docs.select(doc), excludes, doc)
    return every.join(_products(tf, model, key, doc), doc, "left").select(doc, F.coalesce("score", F.lit(0)).alias("score"))


def by_topics(docs: DataFrame, tf: DataFrame, models: DataFrame, topics: Sequence[str], key: str = "token", doc: str = "doc_id") -> DataFrame:
    """(topic, doc_id, score) of every document by each of a few ``topics`` (``models``: topic, token, w), 0 without a weighted token.

    A token's weights are one row, so ``tf`` is joined once, however many topics there are.
    """
    weight = lambda t: F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("w"))), F.lit(0.0))
    weights = models.where((F.col("w") != 0) & F.col("topic").isin(*topics)).groupBy(key).agg(*(weight(t).alias(f"w{i}") for i, t in enumerate(topics)))
    sums = tf.join(looked_up(weights), key).groupBy(doc).agg(*(F.sum(F.col(f"w{i}") * F.col("tf")).alias(f"s{i}") for i in range(len(topics))))
    each = F.array(*(F.struct(F.lit(t).alias("topic"), F.coalesce(f"s{i}", F.lit(0.0)).alias("score")) for i, t in enumerate(topics)))
    return docs.select(doc).join(sums, doc, "left").select(doc, F.explode(each).alias("x")).select("x.topic", doc, "x.score")


def one(tf: DataFrame, model: DataFrame, doc_id, key: str = "token", doc: str = "doc_id") -> DataFrame:
    """(score) of one document; 0 if it has no weighted token."""
    return _products(tf.where(F.col(doc) == doc_id), model, key, doc).agg(F.coalesce(F.sum("score"), F.lit(0)).alias("score"))


def top(scores: DataFrame, n: int, doc: str = "doc_id") -> DataFrame:
    """The ``n`` highest scores, ranked from 1; TakeOrderedAndProject keeps n rows a task."""
    ranked = scores.orderBy(F.col("score").desc(), F.col(doc)).limit(n)
    order = F.struct((-F.col("score")).alias("s"), doc)
    # n rows at most from here on
    return ranked.agg(F.array_sort(F.collect_list(order)).alias("all")).select(F.posexplode("all").alias("i", "r")).select(F.col("r")[doc].alias(doc), (-F.col("r.s")).alias("score"), (F.col("i") + 1).alias("rank"))


def by_topic(tf: DataFrame, models: DataFrame, excludes: DataFrame | None = None, key: str = "token", doc: str = "doc_id") -> DataFrame:
    """(topic, doc_id, score) by the models of several topics (topic, token, w), in one pass over ``tf``.

    ``excludes``: topic, doc_id of what is left out.
    """
    weights = small(models.where("w <> 0").select("topic", key, "w"))
    scores = tf.join(weights, key).groupBy("topic", doc).agg(F.sum(F.col("w") * F.col("tf")).alias("score"))
    return scores if excludes is None else scores.join(small(excludes.select("topic", doc).distinct()), ["topic", doc], "left_anti")


def top_by_topic(scores: DataFrame, n: int, doc: str = "doc_id") -> DataFrame:
    """The ``n`` highest scores of each topic, ranked from 1; each task keeps n rows a topic before the shuffle."""
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    conf = scores.sparkSession.conf
    conf.set(limit, str(max(n, int(conf.get(limit)))))
    best = Window.partitionBy("topic").orderBy(F.col("score").desc(), doc)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def terms_by_weight(model: DataFrame, n: int, key: str = "token") -> DataFrame:
    """The ``n`` non-zero weights of largest absolute value."""
    return model.where("w <> 0").orderBy(F.abs("w").desc(), key).limit(n)


def centroid_model(tf: DataFrame, judged: DataFrame, key: str = "token", doc: str = "doc_id", most: int = MOST_BROADCAST) -> DataFrame:
    """(token, w) by integers: negatives times the positives' frequencies less positives times the negatives'.

    The direction of the first full gradient step of the pairwise loss from zero.  ``judged``: doc_id, rel; up to
    ``most`` of them are broadcast.
    """
    n = judged.agg(F.count_if(F.expr("rel > 0")).alias("pos"), F.count_if(F.expr("rel <= 0")).alias("neg")).first()
    signed = F.when(F.col("rel") > 0, F.lit(n.neg)).otherwise(F.lit(-n.pos))
    return tf.join(looked_up(judged.select(doc, "rel"), most), doc).groupBy(key).agg(F.sum(signed * F.col("tf")).alias("w"))


def centroid_models(tf: DataFrame, judged: DataFrame, key: str = "token", doc: str = "doc_id") -> DataFrame:
    """(topic, token, w): ``centroid_model`` of each topic of ``judged`` (topic, doc_id, rel)."""
    sides = judged.groupBy("topic").agg(F.count_if(F.expr("rel > 0")).alias("pos"), F.count_if(F.expr("rel <= 0")).alias("neg"))
    signed = judged.join(small(sides), "topic").select("topic", doc, F.when(F.col("rel") > 0, F.col("neg")).otherwise(-F.col("pos")).alias("by"))
    return tf.join(small(signed), doc).groupBy("topic", key).agg(F.sum(F.col("by") * F.col("tf")).alias("w"))


def to_json(scores: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(json): one object of docid and score per row."""
    return scores.select(F.to_json(F.struct(F.col(doc).alias("docid"), "score")).alias("json"))
