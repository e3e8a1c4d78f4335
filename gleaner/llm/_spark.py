"""What the operators need of a session: shared folders, sizes, Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import with_checkpoints

#: Rows, and bytes, of an Arrow batch that goes to Python; texts can be long.
ARROW_ROWS, ARROW_BYTES = 4096, 4 << 20


def ready(spark: SparkSession) -> None:
    """Small Arrow batches, and a checkpoint folder if the session has none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    with_checkpoints(spark)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared checkpoint folder, without its lineage."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """``kept``, with the number of rows as "rows" and further aggregates, taken while the rows are written."""
    seen = Observation()
    df = kept(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in more.items())))
    return df, {name: int(n or 0) for name, n in seen.get.items()}


def broadcast_if(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``; for a scan, those of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def stands_still(df: DataFrame) -> bool:
    """Whether ``df`` comes straight from files, given rows or a checkpoint, so that its rows keep their partitions and order."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return set(re.findall(r"(?m)^[\s:+|-]*(\w+)", plan)) <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD"}


def parts_for(df: DataFrame, each: int, most: int = 1 << 16) -> int:
    """As many parts as give each about ``each`` estimated bytes."""
    return max(1, min(most, -(-size_of(df) // each)))


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id (bigint) and text (string), whatever else ``df`` has."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
