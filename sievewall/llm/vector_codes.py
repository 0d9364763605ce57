"""Vector compression: each part of a vector becomes an index into its position's codebook, learnt from the distinct parts by weighted Lloyd rounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import removed, written

#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: A vector's greatest squared distance must stay below this, so that all distances are 64-bit integers.
MOST_SQUARED = 1 << 60
#: Parts compared with a codebook at a time.
BLOCK = 4096


@dataclass
class Codebooks:
    """Of each part position, its entries in order as rows of integers."""

    books: list[np.ndarray]

    @property
    def digest(self) -> str:
        """SHA-256 of all decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def packed(values: np.ndarray) -> pa.Array:
    """Rows of integers as bytes, two a number where all of a row fit in 16 bits and else four, so that equal rows have equal bytes."""
    n, width = values.shape
    narrow = (np.abs(values) < 1 << 15).all(axis=1)
    sizes = np.where(narrow, 2 * width, 4 * width)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.empty(int(offsets[-1]), np.uint8)
    for rows, kind in ((np.flatnonzero(narrow), "<i2"), (np.flatnonzero(~narrow), "<i4")):
        if len(rows):
            raw = np.ascontiguousarray(values[rows].astype(kind)).view(np.uint8).reshape(len(rows), -1)
            data[offsets[rows][:, None] + np.arange(raw.shape[1])] = raw
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The rows of integers again."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, values = np.frombuffer(column.buffers()[2], np.uint8), np.empty((len(column), width), np.int64)
    for kind, size in (("<i2", 2 * width), ("<i4", 4 * width)):
        rows = np.flatnonzero(np.diff(offsets) == size)
        if len(rows):
            values[rows] = data[offsets[rows][:, None] + np.arange(size)].reshape(-1).view(kind).reshape(len(rows), width)
    return values


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the lower index, and its squared distance, both exact."""
    entries, distances = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    reach = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    # Below 2^53 every sum of the expanded square is an integer that a double holds.
    exact = 4 * values.shape[1] * reach * reach < 1 << 53
    of_book = book.astype(np.float64)
    for at in range(0, len(values), BLOCK):
        own = values[at : at + BLOCK]
        if exact:
            x = own.astype(np.float64)
            found = (of_book**2).sum(axis=1) - 2 * (x @ of_book.T) + (x**2).sum(axis=1)[:, None]
        else:
            found = np.stack([((own - entry) ** 2).sum(axis=1) for entry in book], axis=1)
        best = found.argmin(axis=1)
        entries[at : at + BLOCK], distances[at : at + BLOCK] = best, found[np.arange(len(own)), best]
    return entries, distances


def finite(vector: Column) -> Column:
    """Whether no component is null, infinite or not a number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def cut(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """The vectors as packed integer parts: vec_id, label, parts. vectors: vec_id, label, vector, all of parts * width components."""
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(SCALE * flat).astype(np.int64).reshape(-1, width)
            bounds = pa.array(np.arange(0, len(whole) + 1, parts, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(bounds, packed(whole))], names=["vec_id", "label", "parts"])

    return vectors.mapInArrow(run, f"vec_id long, label {label}, parts array<binary>")


def batches_by_position(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The rows of each position, with their parts as integers."""
    for batch in batches:
        positions = batch.column("position").to_numpy()
        for position in np.unique(positions).tolist():
            own = batch.take(pa.array(np.flatnonzero(positions == position)))
            yield own, position, unpacked(own.column("part"), width)


def moved(distinct: DataFrame, model: Codebooks, width: int) -> Codebooks:
    """One Lloyd round: every distinct part adds its weight and its weighted components to its nearest entry; used entries become floor(sum / count).

    A task adds up all of its parts and sends one row for each entry and
    place, place -1 for the count, whatever the number of parts.
    """
    books = model.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for own, position, values in batches_by_position(batches, width):
            entries, _ = nearest(values, books[position])
            weights = own.column("weight").to_numpy()
            order = np.argsort(entries, kind="stable")
            used, first = np.unique(entries[order], return_index=True)
            added = np.concatenate([weights[:, None], values * weights[:, None]], axis=1)[order]
            if position not in sums:
                sums[position] = np.zeros((len(books[position]), width + 1), np.int64)
            sums[position][used] += np.add.reduceat(added, first, axis=0)
        for position, found in sums.items():
            entries = np.flatnonzero(found[:, 0])
            columns = [np.full(found[entries].size, position, np.int32), np.repeat(entries, width + 1).astype(np.int32), np.tile(np.arange(-1, width, dtype=np.int32), len(entries)), found[entries].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["position", "entry", "place", "value"])

    sent = distinct.mapInArrow(run, "position int, entry int, place int, value long")
    # At most parts * entries * (width + 1) rows, whatever the input.
    totals = sent.groupBy("position", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found = {(r.position, r.entry, r.place): int(r.value) for r in totals.collect()}
    new = [book.copy() for book in books]
    for (position, entry, place), value in found.items():
        if place >= 0:
            new[position][entry, place] = value // found[position, entry, -1]
    return Codebooks(new)


def coded_parts(distinct: DataFrame, model: Codebooks, width: int) -> DataFrame:
    """Each distinct part's nearest entry: position, part, entry, distance."""
    books = model.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, position, values in batches_by_position(batches, width):
            entries, distances = nearest(values, books[position])
            yield pa.RecordBatch.from_arrays([own.column("position"), own.column("part"), pa.array(entries.astype(np.int32)), pa.array(distances)], names=["position", "part", "entry", "distance"])

    return distinct.select("position", "part").mapInArrow(run, "position int, part binary, entry int, distance long")


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, and the codebooks: vec_id, label, code, error, label_error.

    Components become floor(1024 * x). A vector is cut into `parts` equal
    consecutive parts. Codebooks start as the parts of the `entries` smallest
    ids (a null id last, equal ids by their bytes) and move for `rounds`
    rounds. code: the parts' entries, two hexadecimal digits each (more, if
    entries need more); error: squared distances, summed; label_error: errors
    of all rows with the label, nulls together.

    Equal parts of a position are one row with a weight from the first shuffle
    on. Rounds run on those distinct rows, each sends what one codebook
    holds a task; codes and errors are joined back to the vectors' parts, with
    a part that very many vectors share split over tasks by Spark's skew join.

    Vectors that are null or empty, or hold a null or non-finite component,
    take no part, nor do those of another length than most have (of lengths
    that `parts` divides; ties to the shorter) or whose squared distances
    might pass 60 bits. Rows repeat as they come; an empty table gives no rows
    and empty codebooks. Other columns are not read.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    usable = own.where(finite(F.col("vector")) & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    length = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        found = own.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return found, Codebooks([np.zeros((0, 0), np.int64)] * parts)
    width = length.n // parts
    most = math.isqrt(MOST_SQUARED // length.n) // 2 / SCALE
    rows = cut(usable.where((F.size("vector") == length.n) & F.forall("vector", lambda x: F.abs(x.cast("double")) < most)), width, parts)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vector-parts")
    split = F.posexplode("parts").alias("position", "part")
    distinct = written(rows.select(split).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).select("parts").collect()
    model = Codebooks([np.concatenate([unpacked(pa.array([bytes(r.parts[p])], pa.binary()), width) for r in first] or [np.zeros((0, width), np.int64)]) for p in range(parts)])
    if first:
        for _ in range(rounds):
            model = moved(distinct, model, width)
    joined = rows.select("row", "vec_id", "label", split).join(coded_parts(distinct, model, width), ["position", "part"])
    digits = max(2, len(f"{max(0, entries - 1):x}"))
    codes = [F.lower(F.lpad(F.hex(F.max(F.when(F.col("position") == p, F.col("entry")))), digits, "0")) for p in range(parts)]
    coded = written(joined.groupBy("row", "vec_id", "label").agg(F.concat(*codes).alias("code"), F.sum("distance").alias("error")).drop("row"), "vector-codes")
    removed(rows, distinct)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), model
