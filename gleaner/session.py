"""Session helpers: the shared checkpoint folder and broadcast bounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; each caller's rows are a few dozen bytes.
MOST_BROADCAST = 200_000
#: The same for rows of two or three numbers, which take about 50 bytes each in the hash table.
MOST_NUMBERS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder of this machine if the session is a local one, as in tests; else an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="gleaner-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder if the session has none."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept without its lineage in the shared checkpoint folder."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept as Parquet in the shared folder until the session's JVM ends.

    For tables of the input's size: a checkpoint is read object by object and in all its columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def looked_up(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, the smaller side of a join, marked for broadcast if ``small``, else to be hashed, so that the larger side is not sorted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_hash")


def placed(df: DataFrame, column: str) -> DataFrame:
    """``df`` dealt by hash of ``column``: what is grouped by it and more columns later on is shuffled no second time."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it would be read by fewer tasks, as a file of one row group is; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
