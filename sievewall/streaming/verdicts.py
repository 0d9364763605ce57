"""The verdict chain over a stream of documents: what passes and what is kept apart, in two sinks, each batch once in each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievewall.operators import delivery

#: Names of the two sinks' folders, and of the column that tells their batches apart.
DELIVERED, QUARANTINED, BATCH = "delivered", "quarantined", "batch_id"


def in_ledger(spark: SparkSession, path: str) -> bool:
    """Whether a batch's folder is whole: Spark's mark of success is the ledger's entry."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """A batch's rows as lines of JSON in the batch's own folder; one that is there whole is left alone, one that was cut off is written anew."""
    path = f"{folder}/{BATCH}={batch}"
    if not in_ledger(rows.sparkSession, path):
        rows.write.mode("overwrite").json(path)


def batch_writer(verdicts_of: Callable[[DataFrame], DataFrame], folder: str, source: str = "scanner", ts: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A function for `foreachBatch`: both sinks of a batch, each at most once whatever is repeated.

    verdicts_of: from documents (doc_id, text) to verdicts as of
    `delivery.chained_verdicts`. Rejected texts go to the quarantine first, so
    that a batch whose delivery is seen has its rejections kept.
    """

    def write(docs: DataFrame, batch: int) -> None:
        judged = verdicts_of(docs)
        write_batch(delivery.quarantined(judged, ts), f"{folder}/{QUARANTINED}", batch)
        write_batch(delivery.delivered(judged, source), f"{folder}/{DELIVERED}", batch)

    return write


def screened_stream(docs: DataFrame, verdicts_of: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, source: str = "scanner", ts: Column | None = None) -> StreamingQuery:
    """Starts the stream: all that is available now, then it stops."""
    writer = docs.writeStream.foreachBatch(batch_writer(verdicts_of, folder, source, ts)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def sink_rows(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The rows of a sink, with their batch."""
    return spark.read.schema(f"{schema}, {BATCH} long").option("recursiveFileLookup", "false").json(f"{folder}/{name}").withColumn(BATCH, F.col(BATCH))
