"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled ids outside the held-out part, the first by hash of doc_id.

    ``labels`` has doc_id and label.  An id with several texts gives one row for each of its first texts by
    batch; ``label`` is null for none.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~S.held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = S.kept(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.join(F.broadcast(chosen), "doc_id")
