"""Readers of corpora, judgments and pools; any path that Spark reads, gzip by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, paths: str | list[str], id_field: str = "doc_id", text_field: str = "text") -> DataFrame:
    """(doc_id, text) of JSON lines; malformed lines, or such without either field, are an error."""
    schema = T.StructType([T.StructField(id_field, T.StringType()), T.StructField(text_field, T.StringType())])
    rows = spark.read.schema(schema).json(paths, mode="FAILFAST")
    needed = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a document has no {c}")).cast("string"))
    return rows.select(needed(id_field).alias("doc_id"), needed(text_field).alias("text"))


def _fields(lines: DataFrame) -> Column:
    return F.split(F.trim("value"), r"\s+")


def qrels(spark: SparkSession, paths: str | list[str], comments: bool = True) -> DataFrame:
    """(topic, doc_id, rel) of "topic iteration docid rel" lines; with ``comments`` lines that begin with # are skipped."""
    lines = spark.read.text(paths)
    return parsed_qrels(lines, comments)


def parsed_qrels(lines: DataFrame, comments: bool = True) -> DataFrame:
    """From a ``value`` column; the first field is the topic, the third the document."""
    if comments:
        lines = lines.where(~F.col("value").startswith("#"))
    f = _fields(lines)
    return lines.where(F.trim("value") != "").select(f[0].alias("topic"), f[2].alias("doc_id"), f[3].cast("int").alias("rel"))


def excludes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct (doc_id) of a file in the layout of judgments; comments aren't known here."""
    return parsed_qrels(spark.read.text(paths), comments=False).select("doc_id").distinct()


def last_judgments(lines: DataFrame, topic: str) -> DataFrame:
    """(doc_id, rel) of one topic; ``lines``: topic, doc_id, rel, line_no.  Of repeated ones the last counts."""
    return lines.where(F.col("topic") == topic).groupBy("doc_id").agg(F.max_by("rel", "line_no").alias("rel"))


def pool(spark: SparkSession, paths: str | list[str], topic: str | None = None, depth: int | None = None) -> DataFrame:
    """(topic, doc_id, rank) of "topic docid rank ..." lines."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    f = _fields(lines)
    rows = lines.select(f[0].alias("topic"), f[1].alias("doc_id"), f[2].cast("int").alias("rank"))
    if topic is not None:
        rows = rows.where(F.col("topic") == topic)
    return rows if depth is None else rows.where(F.col("rank") <= depth)
