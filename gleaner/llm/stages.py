"""The operators as stages over documents: each takes (spark, docs, sf_dir) and works on all rows it is given.

All but the last return the columns of ``docs`` unchanged in name and order.  ``docs`` may hold null or repeated
rows and further columns; what a stage decides follows its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import decontaminate, neardup, packing, quality, secrets
from .queries import bpe_path

#: Ids to be dropped up to which they are broadcast.
MOST_BROADCAST = 250_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects.

    It is fitted on the stage's own documents; rows whose doc_id is null are judged by their text all the same.
    """
    S.ready(spark)
    own = S.documents(docs)
    labels = S.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint"), F.col("quality").cast("double").alias("label"))
    passes = quality.predicate(spark, quality.fit(own, labels))
    return docs.where(passes(F.col("text").cast("string")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id, by shingles of five words.

    Of rows that repeat a doc_id, the first by text and then the other columns that can be ordered.
    """
    S.ready(spark)
    found, seen = S.counted(neardup.near_duplicates(docs), dropped=F.count_if(~F.col("kept")))
    drop = S.broadcast_if(found.where("NOT kept").select(F.col("doc_id").alias("dropped")), seen["dropped"] <= MOST_BROADCAST)
    out = docs.join(drop, docs["doc_id"].cast("bigint") == drop["dropped"], "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return out
    order = F.struct("text", *(c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant", "struct", "array"))))
    single = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("*"), order).alias("row")).select("row.*")
    return single.unionByName(out.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap with a benchmark item."""
    return decontaminate.clean(docs, S.table(spark, sf_dir, "benchmark"), whole=decontaminate.PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text by their kind; all documents stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences; see ``packing.pack``."""
    return packing.pack(docs, bpe_path())
