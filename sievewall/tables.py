"""Intermediate tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Where a session on one machine names none (tests) a fresh temporary
    folder is set for it, once; on a cluster that is an error, as each
    executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again.

    This cuts lineage: what reads it several times costs a read each, and a
    lost executor a read, not the work before it.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/sievewall-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found.written_to = path
    return found


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over as many tasks as there are cores, four times: for short rows that become long texts.

    A table of short rows is a file or two, so a task or two, whatever its rows
    are made into. The number is a given one, as Spark would merge parts that
    are small before they are made into anything.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by their keys over as many tasks as a shuffle has, however well they compress: windows and sums by these keys, and more, follow without another shuffle."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def removed(*frames: DataFrame) -> None:
    """Removes the files of written tables that nothing reads any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
