"""Documents to training sequences: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import stages
from gleaner.session import remove, shared_folder

STAGES = [
    ("quality", stages.keep_quality),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("secrets", stages.mask_secrets),
    ("packing", stages.pack),
]

#: Classifier votes, components, substitution-tolerant overlaps, decoded layers and token ids have no SQL form;
#: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each is written to the shared checkpoint folder, where only the last one's rows stay, as the result reads them.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    return docs
