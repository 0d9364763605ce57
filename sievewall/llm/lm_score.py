"""Cross-entropy difference: how much better a target model predicts a text than a background model does."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices, written
from .textarrays import BLANK_BYTES, flat_text, lowered, mix64, span_hashes, table64, word_spans

#: Texts are read in chunks of about so many words, each with its distinct words numbered.
CHUNK = 1 << 20
#: Words, and pairs too, are dealt by the leading bits of their keys into bins, one for each chunk and so many at least; a bin is counted in one piece.
LEAST_BINS = 64
#: What stands before a text's first word.
START = table64(1, 29)
#: Weight of the pair model against the single-word model, and what is added to every single-word count.
PAIR_WEIGHT, ADDED = 0.7, 0.5

#: A chunk: its documents (sizes in words, side, ids), its distinct words' keys in order, and every word by its number.
CHUNKED = "chunk long, ids array<long>, sides binary, sizes binary, keys binary, words binary, n_target long, n_background long"
#: A chunk's keys of one bin, with their counts in the chunk.
KEYED = "chunk long, bin int, keys binary, n_target binary, n_background binary"
#: The counts over the whole corpus for a chunk's keys of one bin, or (without a chunk) what a bin of words adds up to.
COUNTED = "chunk long, bin int, n_target binary, n_background binary, n_distinct long, all_target long, all_background long"
SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, difference double"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's begin (n + 1 bounds)."""
    flat, offsets = flat_text(column)
    starts, ends, bounds = word_spans(flat, offsets, BLANK_BYTES)
    return span_hashes(lowered(flat), starts, ends, salt=23), bounds


def words_before(words: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The word before each word; `start` at a text's start."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    return before


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all lowest bytes first."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(packed: bytes, dtype: type) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.tobytes(), dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def batch_of(schema: str, n: int, columns: dict[str, pa.Array | list]) -> pa.RecordBatch:
    """A batch of the schema's columns; those that are not given are null."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    arrays = [pa.nulls(n, types[kind]) if name not in columns else columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], types[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def chunk_row(held: list[tuple]) -> pa.RecordBatch:
    """The texts that are held, as a chunk of a number of its own."""
    hashes, sizes, target = (np.concatenate([x[i] for x in held]) for i in range(3))
    keys, words = np.unique(hashes, return_inverse=True)
    ids = pa.concat_arrays([x[3] for x in held])
    row = {"chunk": [int.from_bytes(os.urandom(8), "little") >> 1], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
    row |= {"sides": [pack(target.astype(np.uint8))], "sizes": [pack(sizes.astype(np.int32))], "keys": [pack_keys(keys)], "words": [pack(words.astype(np.int32))]}
    row |= {name: [int((sizes[target == side] > 0).sum())] for name, side in (("n_target", True), ("n_background", False))}
    return batch_of(CHUNKED, 1, row)


def chunked(texts: DataFrame) -> DataFrame:
    """The texts in chunks. texts: doc_id, text, in_target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_slices(batches, "text"):
            hashes, bounds = word_hashes(batch.column("text"))
            held.append((hashes, np.diff(bounds).astype(np.int64), batch.column("in_target").to_numpy(zero_copy_only=False).astype(bool), batch.column("doc_id")))
            size += len(hashes) + batch.num_rows
            if size >= CHUNK:
                yield chunk_row(held)
                held, size = [], 0
        if held:
            yield chunk_row(held)

    return texts.mapInArrow(run, CHUNKED)


class Chunk:
    """A chunk's row, unpacked: words by number, and pairs by the rank of their keys."""

    def __init__(self, row: dict):
        self.number, self.ids = row["chunk"], row["ids"]
        self.target, self.sizes = unpack(row["sides"], np.uint8).astype(bool), unpack(row["sizes"], np.int32).astype(np.int64)
        self.word_keys, self.words = unpack_keys(row["keys"]), unpack(row["words"], np.int32).astype(np.int64)
        self.before = words_before(self.words, self.sizes, len(self.word_keys))
        base = len(self.word_keys) + 1
        codes, pairs = np.unique(self.before * base + self.words, return_inverse=True)
        keys = mix64(mix64(np.concatenate([self.word_keys, START])[codes // base]) + self.word_keys[codes % base] * np.uint64(0x9E3779B97F4A7C15)) if len(codes) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.pair_keys, self.pairs = keys[order], rank[pairs]

    def counts(self, numbers: np.ndarray, n: int) -> list[np.ndarray]:
        """How often each number occurs in target texts, and in background texts."""
        if not self.target.any():
            return [np.zeros(n, np.int64), np.bincount(numbers, minlength=n)]
        side = np.repeat(self.target, self.sizes)
        return [np.bincount(numbers[side == x], minlength=n) for x in (True, False)]


def keyed(chunks: DataFrame, bins: int) -> DataFrame:
    """Each chunk's distinct words and pairs with their counts in it, a row for each bin that has some."""
    shift = np.uint64(64 - (bins.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                for first_bin, keys, numbers in ((0, chunk.word_keys, chunk.words), (bins, chunk.pair_keys, chunk.pairs)):
                    counts = chunk.counts(numbers, len(keys))
                    found, cuts = np.unique((keys >> shift).astype(np.int64), return_index=True)
                    some = list(zip(found.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)][: len(cuts)], strict=True))
                    columns = {"chunk": [chunk.number] * len(some), "bin": [first_bin + k for k, _, _ in some], "keys": [pack_keys(keys[a:b]) for _, a, b in some]}
                    columns |= {name: [pack(x[a:b].astype(np.int32)) for _, a, b in some] for name, x in zip(("n_target", "n_background"), counts, strict=True)}
                    yield batch_of(KEYED, len(some), columns)

    return chunks.select("chunk", "ids", "sides", "sizes", "keys", "words").mapInArrow(run, KEYED)


def counted(keys: DataFrame) -> DataFrame:
    """The whole corpus's counts of each chunk's keys, bin by bin."""

    def run(table: pa.Table) -> pa.Table:
        own = [unpack_keys(x.as_py()) for x in table["keys"]]
        found, at = np.unique(np.concatenate(own), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([unpack(x.as_py(), np.int32) for x in table[name]]), minlength=len(found)).astype(np.int64) for name in ("n_target", "n_background")]
        ends = np.cumsum([len(x) for x in own]).tolist()
        columns = {name: [pack(x[at[a:b]]) for a, b in zip([0, *ends], ends, strict=False)] for name, x in zip(("n_target", "n_background"), sums, strict=True)}
        rows = batch_of(COUNTED, table.num_rows, columns | {"chunk": table["chunk"].to_pylist(), "bin": table["bin"].to_pylist()})
        totals = {"bin": [table["bin"][0].as_py()], "n_distinct": [len(found)], "all_target": [int(sums[0].sum())], "all_background": [int(sums[1].sum())]}
        return pa.Table.from_batches([rows, batch_of(COUNTED, 1, totals)])

    return keys.groupBy("bin").applyInArrow(run, COUNTED)


def own_counts(docs: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """How often the document of each place has the number that stands there."""
    _, at, counts = np.unique(docs * n + numbers, return_inverse=True, return_counts=True)
    return counts[at]


def losses_of(chunk: Chunk, counts: list[np.ndarray], totals: list[float], texts: list[int]) -> list[np.ndarray]:
    """The loss of each word of a chunk, under the target and under the background model without the word's own document.

    counts: of the chunk's words and then pairs, over the target and over the
    background. totals: all words of each with what smoothing adds; texts:
    how many texts with words each has.
    """
    n_words = len(chunk.word_keys)
    docs = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
    own_word, own_pair = own_counts(docs, chunk.words, n_words), own_counts(docs, chunk.pairs, len(chunk.pair_keys))
    own_before = words_before(own_word, chunk.sizes, 1)
    # Target texts have no part in the background; their losses are not asked for.
    background = np.repeat(~chunk.target, chunk.sizes)
    losses = []
    for side, (found, total, n_texts) in enumerate(zip(counts, totals, texts, strict=True)):
        single, pair, context = found[:n_words][chunk.words], found[n_words:][chunk.pairs], np.append(found[:n_words], n_texts)[chunk.before]
        if side:
            single, pair, context, total = single - own_word * background, pair - own_pair * background, context - own_before * background, total - np.repeat(chunk.sizes, chunk.sizes) * background
        losses.append(-np.log(PAIR_WEIGHT * np.minimum(pair / np.maximum(context, 1), 1.0) + (1 - PAIR_WEIGHT) * (single + ADDED) / total))
    return losses


def scored(chunks: DataFrame, counts: DataFrame, bins: int, texts: list[int]) -> DataFrame:
    """Each document's losses, from its chunk's numbers and their counts over the whole corpus."""
    sums = counts.where(F.col("chunk").isNull() & (F.col("bin") < bins)).agg(F.sum("n_distinct").alias("n"), F.sum("all_target").alias("t"), F.sum("all_background").alias("b")).first()
    # One more than the words there are, for the word that neither corpus has.
    totals = [(x or 0) + ADDED * ((sums.n or 0) + 1) for x in (sums.t, sums.b)]

    def run(found: pa.Table, rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows.to_pylist()[0])
        found = found.sort_by("bin")
        n, sides = chunk.sizes, ~chunk.target
        docs, means = np.repeat(np.arange(len(n)), n), []
        if len(chunk.words):
            of_keys = [np.concatenate([unpack(x.as_py(), np.int64) for x in found[name]]) for name in ("n_target", "n_background")]
            for loss in losses_of(chunk, of_keys, totals, texts):
                means.append(np.bincount(docs, weights=loss, minlength=len(n)) / np.maximum(n, 1))
        else:
            means = [np.zeros(len(n)), np.zeros(len(n))]
        ids = pa.array(chunk.ids, pa.int64()).filter(pa.array(sides))
        empty = n[sides] == 0
        losses = {k: pa.array(v[sides], pa.float64(), mask=empty) for k, v in (("loss_target", means[0]), ("loss_background", means[1]), ("difference", means[0] - means[1]))}
        return pa.Table.from_batches([batch_of(SCORES, len(ids), {"doc_id": ids, "n_tokens": pa.array(n[sides])} | losses)])

    keyed_counts = counts.where("chunk is not null").select("chunk", "bin", "n_target", "n_background")
    return keyed_counts.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(run, SCORES)


def cross_entropy_difference(target: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text's losses per token: doc_id, n_tokens, loss_target, loss_background, difference.

    The target model is learnt from all of `target`'s texts, the background
    from all of `docs`'s, over all their words. A document is scored by the
    background of all other documents, as one that it helped to build would
    know it already. difference is loss_target minus loss_background: the
    lower, the more the text is like the target. Texts that are null or have
    no words have no tokens and null losses. A row gives a row; other columns
    are not read.

    Every word and every pair is counted: keys are 64-bit digests, which at
    five billion distinct pairs one pair of them is expected to share, and
    nothing is capped. A chunk of the corpus is a row of numbered words; it
    sends each distinct key once, so that a frequent word or pair has a row
    for each chunk at most, and gets the key's counts back in the same order.
    There are as many bins of keys as there are chunks: a bin holds as many
    keys as a chunk sends, whatever the corpus, and a chunk sends a row for each
    bin that it has keys of, so never more rows than it has keys.
    """
    own = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(True).alias("in_target"))
    texts = own.unionByName(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(False).alias("in_target")))
    chunks = written(chunked(texts), "lm-chunks")
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum("n_target").alias("t"), F.sum("n_background").alias("b")).first()
    bins = 1 << (max(LEAST_BINS, size.n) - 1).bit_length()
    counts = written(counted(keyed(chunks, bins)), "lm-counts")
    return scored(chunks, counts, bins, [size.t or 0, size.b or 0])
