"""Small inputs that hold every awkward case: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns whose names the operators use inside.
CLASHES = "n bigint, key string, label double, a bigint, b bigint, score double, part int, block bigint, term string, component bigint, rep bigint, kept boolean, x double, n_a bigint, hashes binary, dropped bigint"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"
_REST = (7, "k", 0.5, 1, 2, 0.25, 3, 4, "t", 5, 6, True, 1.5, 8, b"h", 9)

LONG = " ".join(f"word{i % 9973} and{i % 13}" for i in range(120_000))
ROWS = [
    (None, "a document without an id that has more than ten words in it today", "en", None),
    (1, None, None, "s"),
    (2, "", "en", "s"),
    (3, " \n\t ", "fr", "s"),
    (4, "word", "fr", "s"),
    (5, "the same text stands here more than once and has more than ten words", "en", "s"),
    (5, "the same text stands here more than once and has more than ten words", "en", "s"),
    (6, "the same text stands here more than once and has more than ten words", "en", "t"),
    (7, LONG, "en", "s"),
    (8, "été à l'école où naître ç'est 日本語 \U0001f600 déjà vu et puis encore dix mots", "fr", "s"),
    (-9, "!!! ### 12 %% --", None, None),
]


def documents(spark: SparkSession, rows=None) -> DataFrame:
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(d, t, lang, source, None if t is None else len(t), *_REST) for d, t, lang, source in rows], SCHEMA)


def plain(spark: SparkSession, texts: dict) -> DataFrame:
    """(doc_id, text) of a few texts."""
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
