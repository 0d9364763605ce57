"""Written intermediate tables, hashing by id, and Arrow batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words everywhere in this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
#: A word: a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


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


def written(frame: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again.

    This cuts lineage: a lost executor costs a read, not the work before it.
    A `narrow` table has a few numbers a row and comes out of a shuffle; it is
    written in an eighth of the shuffle's partitions, as files cost more there
    than rows.
    """
    spark = frame.sparkSession
    if narrow:
        frame = frame.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_folder(spark)}/sievewall-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found.written_to = path
    return found


def removed(*frames: DataFrame) -> None:
    """Removes the files of written tables that nothing reads any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of rows that agree in `keys` one: the first by the JSON of its columns, found by a sum that Spark makes before it shuffles."""
    own = F.struct(*[F.col(f"`{x}`") for x in columns])
    return rows.groupBy(*keys).agg(F.min_by(own, F.to_json(own)).alias("_row")).select("_row.*")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Whether training must not see the row; a row without an id is held out too."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(True))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with about `limit` bytes of text each.

    Each byte takes some fifty in the arrays that are made of it. A single
    longer text makes a slice of its own; texts are never cut.
    """
    for batch in batches:
        ends = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        begin, base = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(ends.searchsorted(base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin, base = end, ends[end - 1]
