"""Overlapping windows over long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_count(length: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return F.when(length <= size, F.lit(1)).otherwise(F.lit(1) + F.ceil((length - size) / step)).cast("int")


def text_windows(docs: DataFrame, size: int, overlap: int, most: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_windows, ord, window: windows of `size` characters, each `overlap` into the one before.

    A text of more than `most` windows is not cut: it gives one row with a
    null ord and window. Nulls count as empty, which is one empty window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to under size")
    step = size - overlap
    counted = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("n_windows", window_count(F.length("_t"), size, overlap))
    fits = F.lit(True) if most is None else F.col("n_windows") <= most
    cut = F.transform(F.sequence(F.lit(0), F.col("n_windows") - 1), lambda i: F.substr(F.col("_t"), i * step + 1, F.lit(size)))
    empty = F.array(F.lit(None).cast("string"))
    rows = counted.select(doc_id, "n_windows", F.posexplode(F.when(fits, cut).otherwise(empty)).alias("ord", "window"))
    return rows.withColumn("ord", F.when(F.col("window").isNotNull(), F.col("ord")))


def first_failure(windows: DataFrame, reason: str = "reason", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, reason: that of the first window that did not pass, else pass."""
    bad = F.when(F.col(reason) != "pass", F.struct("ord", F.col(reason).alias("reason")))
    return windows.groupBy(doc_id).agg(F.coalesce(F.min(bad)["reason"], F.lit("pass")).alias("reason"))
