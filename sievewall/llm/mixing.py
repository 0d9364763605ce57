"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

#: Keys fall into so many buckets of a source; only the bucket in which its budget ends is sorted.
BUCKETS = 4096


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) fixed by the id: 52 bits of its MD5, plus one half."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """Efraimidis-Spirakis: an exponential key of rate `weight`; ascending keys are a weighted sample."""
    return -F.log(uniform(doc_id)) / weight


def water_filled(sources: DataFrame, most: float) -> DataFrame:
    """The target of each source: source, source_size -> target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the
    total by weight; a target stops at `most` times its source's size and the
    excess goes to the others by weight. With sources sorted by the level at
    which each fills up, that is one pass of prefix sums: the level is the
    first at which the rest, shared by weight, fills no further source; from
    there on the computed levels only fall, so it is also the largest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    steps = (
        sources.withColumn("share", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_at", F.col("cap") / F.col("share"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_shares", F.sum("share").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("share_before", F.coalesce(F.sum("share").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_shares") - F.col("share_before")))
        .withColumn("open_level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole))
    )
    return steps.select(
        "source",
        "source_size",
        F.when(F.col("level") > F.col("full_at"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("share") * F.coalesce("open_level", "level"))).alias("target"),
    )


def mix(docs: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    size counts the words of the text (null: 0). A source is taken in complete
    epochs as often as its target holds it; the rest of the target goes to the
    documents with the smallest exponential keys, whose rates are the quality
    weights (1 for quality 1, 0.25 for quality 0, 0.5 where `quality` has no
    row; of several rows the highest counts). A document is taken while at
    least half of it fits, so a source misses its target by half a document
    at most. A null source is a source of its own. Rows repeated under one id
    are documents each; an empty table gives no rows. Other columns are not
    read. Keys depend on ids alone, so reruns agree.

    No source is sorted whole: keys fall into BUCKETS per source, sums by
    bucket find the one in which the budget ends, and only its rows are
    ordered.
    """
    return copied(docs, quality, doc_id, text, source, most, False).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def copied(docs: DataFrame, quality: DataFrame | None, doc_id: str, text: str, source: str, most: float, whole: bool) -> DataFrame:
    """What `mix` returns but for taken; `whole` adds each row's own columns as the struct `row`."""
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        *([F.struct(*[docs[x] for x in docs.columns]).alias("row")] if whole else []),
    )
    if quality is None:
        base = base.withColumn("quality", F.lit(None).cast("int"))
    else:
        known = quality.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_quality")).groupBy("_id").agg(F.max("_quality").alias("quality"))
        # Labels grow with the documents: merged at every size, so that the plan for few documents is the one for many.
        base = base.join(known.hint("merge"), base.doc_id == known._id, "left").drop("_id")
    weight = F.when(F.col("quality") >= 1, 1.0).when(F.col("quality") <= 0, 0.25).otherwise(0.5)
    base = base.withColumn("key", sampling_key(F.col("doc_id"), weight)).drop("quality")
    base = base.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * BUCKETS).cast("int"))
    base = written(base, "mix-sizes")

    by_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_bucket = written(by_bucket, "mix-buckets")
    sources = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = water_filled(sources, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = written(targets, "mix-targets")

    ordered = Window.partitionBy("source").orderBy("bucket")
    sums = by_bucket.withColumn("until", F.sum("bucket_size").over(ordered))
    t = targets.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "rest")
    cut = (
        sums.join(t, sums.source.eqNullSafe(t._source))
        .where(F.col("until") > F.col("rest"))
        .groupBy("_source")
        .agg(F.min(F.struct("bucket", (F.col("until") - F.col("bucket_size")).alias("before"))).alias("cut"))
        .select(F.col("_source").alias("_cut_source"), F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("before"))
    )
    plan = t.join(cut, t._source.eqNullSafe(cut._cut_source), "left").drop("_cut_source")
    plan = written(plan, "mix-plan")

    joined = base.join(plan, base.source.eqNullSafe(plan._source)).drop("_source")
    at_cut = F.coalesce(F.col("bucket") == F.col("cut_bucket"), F.lit(False))
    clear = joined.where(~at_cut).withColumn("copies", F.col("epochs") + F.when(F.coalesce(F.col("bucket") > F.col("cut_bucket"), F.lit(False)), 0).otherwise(F.when(F.col("rest") > 0, 1).otherwise(0)))
    in_bucket = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    close = (
        joined.where(at_cut)
        .withColumn("until", F.col("before") + F.sum("size").over(in_bucket))
        .withColumn("copies", F.col("epochs") + F.when(F.col("until") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0))
        .drop("until")
    )
    return clear.unionByName(close)


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0) -> DataFrame:
    """The mix itself: each document's row as often as `mix` takes it, with all its columns; rows that share an id are taken each by its own count."""
    taken = copied(docs, quality, doc_id, text, source, most, True).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
