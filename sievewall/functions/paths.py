"""Relative paths without a file system: where they lead below a root, if they stay below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confined(path: Column) -> Column:
    """The path's segments below the root, joined by /, or null for one that leaves the root on its way or names the root itself.

    `.` and empty segments say nothing, `..` takes back the last one. A path
    that begins with a slash or a drive, or holds a backslash or a zero
    character, is none below the root.
    """
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("inside"))

    def step(s: Column, part: Column) -> Column:
        up = part == ".."
        kept = F.when(up, F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).when(part.isin("", "."), s["kept"]).otherwise(F.array_append(s["kept"], part))
        return F.struct(kept.alias("kept"), (s["inside"] & ~(up & (F.size(s["kept"]) == 0))).alias("inside"))

    folded = F.aggregate(F.split(path, "/", -1), state, step)
    odd = path.rlike(r"^(?:/|[A-Za-z]:)|[\\\x00]")
    # One lambda variable holds the fold, so that it runs once.
    return F.try_element_at(F.transform(F.array(folded), lambda f: F.when(~odd & f["inside"] & (F.size(f["kept"]) > 0), F.array_join(f["kept"], "/"))), F.lit(1))


def local_contents(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """change_id, path, content of the wanted paths that lead to a stored file below the root; the content of others is null.

    wanted(change_id, path), stored(path, content): paths below the root, as
    of Spark's binary file source without its folder.
    """
    own = wanted.withColumn("_place", confined(F.col("path")))
    return own.join(stored.select(F.col("path").alias("_place"), "content"), "_place", "left").select("change_id", "path", "content")
