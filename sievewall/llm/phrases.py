"""Phrase collocation mining: count-min sketches choose which n-grams are counted exactly; candidates are scored by their weakest cut and subsumed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lm_score import pack, unpack
from .shared import text_slices, written
from .textarrays import byte_class, flat_text, gathered, lowered, mix64, span_hashes, word_spans

#: What parts pieces, and what parts words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = byte_class(PIECE_ENDS + b" \t")
#: A sketch has two rows of 2 ** width counters, about LOAD n-grams to a counter, within these widths.
ROWS, LOAD, NARROWEST, WIDEST = 2, 4, 20, 29
#: Counters are sent and merged in blocks of so many; a task sends after so many touched ones.
BLOCK, TOUCHED = 1 << 20, 1 << 22
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1 << 21
#: Counts are merged in bins of the n-grams' hashes, one for so many bytes of text, and so many at least.
BIN, BINS = 1 << 23, 64
#: Each language's candidates are ranked in so many parts first.
PARTS = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

GRAMS = "lang string, size int, phrase string, f long"
#: A task's n-grams of a bin, language and size: in order, each with a line end, and their counts; compressed.
SENT = "bin int, lang string, size int, phrases binary, counts binary"


def joined(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, size: int) -> pa.Array:
    """The strings of `size` words each from word `first` on, joined by single spaces."""
    with_space = np.append(flat, np.uint8(32))
    at = np.full((len(first), 2 * size - 1), len(flat), np.int64)
    sizes = np.ones((len(first), 2 * size - 1), np.int64)
    for k in range(size):
        at[:, 2 * k], sizes[:, 2 * k] = starts[first + k], ends[first + k] - starts[first + k]
    data = with_space[gathered(at.ravel(), sizes.ravel())] if len(first) else with_space[:0]
    offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Words:
    """The words of a batch of texts: bytes, spans, the text and the piece of each, and the n-grams' hashes."""

    def __init__(self, batch: pa.RecordBatch):
        flat, offsets = flat_text(batch.column("text"))
        self.flat, self.langs = lowered(flat), batch.column("lang")
        self.starts, self.ends, bounds = word_spans(flat, offsets, GAPS)
        self.text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        ended = np.cumsum(byte_class(PIECE_ENDS)[flat], dtype=np.int64)
        # Neither part ever falls, so two words have the same sum only in one piece of one text.
        self.piece = (ended[self.starts] if len(flat) else np.zeros(0, np.int64)) + self.text

    def hashes(self, salt: int) -> np.ndarray:
        """A hash of each word with its language."""
        langs, offsets = flat_text(self.langs)
        of_langs = span_hashes(langs, offsets[:-1], offsets[1:], salt + 1) if len(langs) else np.zeros(len(self.langs), np.uint64)
        return mix64(span_hashes(self.flat, self.starts, self.ends, salt) + of_langs[self.text] * MULTIPLIER)

    def grams(self, hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size, where its n-grams begin, and their hashes."""
        found, first = hashes, np.arange(len(hashes))
        for size in range(1, longest + 1):
            if size > 1:
                n = max(0, len(hashes) - size + 1)
                found = found[:n]
                first = np.flatnonzero(self.piece[:n] == self.piece[size - 1 :][:n])
                found = mix64(found * MULTIPLIER + hashes[size - 1 :][:n])
            yield size, first, found[first]


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def width_for(size: int, longest: int) -> int:
    """A width in proportion to the corpus: a word and the gap after it are taken for six bytes."""
    return min(WIDEST, max(NARROWEST, (size * longest // (6 * LOAD)).bit_length()))


def cells_of(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """Each hash's counter in each row of the sketch, rows end to end."""
    return [(hashes >> np.uint64(32 * k) & np.uint64((1 << width) - 1)).astype(np.uint32) + np.uint32(k << width) for k in range(ROWS)]


def sums_of(cells: np.ndarray, counts: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, each with its counts added up, `least` at most."""
    order = np.argsort(cells, kind="stable") if counts is not None else None
    cells = np.sort(cells) if order is None else cells[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(cells))) if order is None else np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return cells[first], np.minimum(sums, least).astype(np.uint32)


def sketched(texts: DataFrame, least: int, longest: int, width: int) -> np.ndarray:
    """One bit for each counter of the merged sketch: whether it reaches `least`.

    A task adds its n-grams up in a sketch of its own, of which it holds the
    counters that it has touched, and sends these block by block; one pass
    over each block's rows merges them. Counters stop at `least`, which
    changes no answer: a sum with one that has stopped reaches it too. What
    comes to the driver is 2 ** (width + 1) bits.
    """
    block = min(BLOCK, 1 << width)

    def blocks(cells: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers, first = np.unique(cells // np.uint32(block), return_index=True)
        ends = [*first[1:].tolist(), len(cells)]
        rows = [pack(np.diff(cells[a:b] % np.uint32(block), prepend=np.uint32(0))) for a, b in zip(first.tolist(), ends, strict=True)]
        sums = [pack(counts[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(rows, pa.binary()), pa.array(sums, pa.binary())], names=["block", "cells", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_slices(batches, "text"):
            words = Words(batch)
            cells = [c for _, _, hashes in words.grams(words.hashes(31), longest) for c in cells_of(hashes, width)]
            held.append(sums_of(np.concatenate(cells), None, least))
            size += len(held[-1][0])
            if size > TOUCHED:
                yield from blocks(*sums_of(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), least))
                held, size = [], 0
        if size:
            yield from blocks(*sums_of(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), least))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for number, cells, counts in zip(batch.column("block").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
                if number != at:
                    if at is not None:
                        yield bits()
                    at, sums = number, np.zeros(block, np.uint32)
                own = np.cumsum(unpack(cells.as_py(), np.uint32))
                sums[own] = np.minimum(sums[own] + unpack(counts.as_py(), np.uint32), least)
        if at is not None:
            yield bits()

    sent = texts.mapInArrow(count, "block int, cells binary, counts binary")
    merged = sent.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    found = np.zeros((ROWS << width) // 8, np.uint8)
    for r in merged.collect():
        own = np.frombuffer(bytes(r.bits), np.uint8)
        found[r.block * (block // 8) : r.block * (block // 8) + len(own)] = own
    return found


class Tally:
    """Distinct n-grams with their counts; told apart by two hashes of 64 bits."""

    def __init__(self):
        self.held, self.size, self.langs = [], 0, {}

    @staticmethod
    def runs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order, and where each run of equal pairs of hashes begins in it."""
        order = np.argsort(first, kind="stable")
        a, b = first[order], second[order]
        return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)

    def add(self, words: Words, size: int, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        order, begins = self.runs(first, second)
        one = order[begins]
        n = np.diff(np.append(begins, len(order)))
        phrases = joined(words.flat, words.starts, words.ends, at[one], size)
        numbers = np.array([self.langs.setdefault(x, len(self.langs)) for x in words.langs.to_pylist()], np.int32)
        self.held.append((first[one], second[one], n, np.full(len(one), size, np.int8), numbers[words.text[at[one]]], phrases))
        self.size += len(one)

    def merge(self) -> None:
        a, b, n, size, lang = (np.concatenate([x[i] for x in self.held]) for i in range(5))
        phrases = pa.concat_arrays([x[5] for x in self.held])
        self.held = []
        order, begins = self.runs(a, b)
        one = order[begins]
        self.held = [(a[one], b[one], np.add.reduceat(n[order], begins), size[one], lang[one], phrases.take(pa.array(one)))]
        self.size = len(one)

    def taken(self, bins: int) -> Iterator[pa.RecordBatch]:
        """What is held, packed by bin, language and size."""
        if self.size:
            self.merge()
            a, _, n, size, lang, phrases = self.held[0]
            # Phrases hold no line ends, as these end pieces.
            phrases = pc.binary_join_element_wise(phrases, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
            group = ((a >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64) * len(self.langs) + lang) * 128 + size
            order = pc.sort_indices(phrases).to_numpy()
            order = order[np.argsort(group[order], kind="stable")]
            group, n, phrases = group[order], n[order], phrases.take(pa.array(order))
            offsets, data = np.frombuffer(phrases.buffers()[1], np.int64), phrases.buffers()[2]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            names, ends = list(self.langs), [*first[1:].tolist(), len(group)]
            for begin in range(0, len(first), 256):
                cuts = list(zip(first[begin : begin + 256].tolist(), ends[begin : begin + 256], strict=True))
                keys = group[first[begin : begin + 256]]
                texts = [pa.compress(data.slice(int(offsets[x]), int(offsets[y] - offsets[x])), codec="zstd", asbytes=True) for x, y in cuts]
                sizes = [(int(offsets[y] - offsets[x])).to_bytes(8, "little") for x, y in cuts]
                columns = [pa.array((keys // 128 // len(names)).astype(np.int32)), pa.array([names[k] for k in (keys // 128 % len(names)).tolist()], pa.string()), pa.array((keys % 128).astype(np.int32))]
                columns += [pa.array([x + y for x, y in zip(sizes, texts, strict=True)], pa.binary()), pa.array([pack(n[x:y].astype(np.int64)) for x, y in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bin", "lang", "size", "phrases", "counts"])
        self.held, self.size = [], 0


def survivors(texts: DataFrame, bits: Broadcast, longest: int, width: int, bins: int) -> DataFrame:
    """The n-grams that the sketch lets through, with their counts in a task; size 0 and no phrase: all words of a language.

    An n-gram is let through if its own counters are full and its two
    n-grams of one word less were let through, as they occur no less often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, totals, full = Tally(), {}, bits.value
        for batch in text_slices(batches, "text"):
            words = Words(batch)
            for found in pc.value_counts(words.langs.take(pa.array(words.text))).to_pylist():
                totals[found["values"]] = totals.get(found["values"], 0) + found["counts"]
            passed = np.ones(len(words.starts) + 1, bool)
            for (size, at, first), (_, _, second) in zip(words.grams(words.hashes(31), longest), words.grams(words.hashes(37), longest), strict=True):
                through = passed[at] & (passed[at + 1] if size > 1 else True)
                for cells in cells_of(first, width):
                    through &= (full[cells >> np.uint32(3)] >> (7 - (cells & np.uint32(7))).astype(np.uint8) & 1).astype(bool)
                passed = np.zeros(len(words.starts) + 1, bool)
                passed[at[through]] = True
                tally.add(words, size, at[through], first[through], second[through])
            if tally.size > HELD:
                tally.merge()
                if tally.size > HELD // 2:
                    yield from tally.taken(bins)
        yield from tally.taken(bins)
        if totals:
            n = len(totals)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(list(totals), pa.string()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([pack(np.array([x], np.int64)) for x in totals.values()], pa.binary())], names=["bin", "lang", "size", "phrases", "counts"])

    return texts.mapInArrow(run, SENT)


def merged_counts(sent: DataFrame, least: int) -> DataFrame:
    """The n-grams of all tasks with their sums, bin by bin, those below `least` left out."""

    def summed(lang: str, size: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([unpack(c, np.int64) for _, c in held])
        if not size:
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([0], pa.int32()), pa.nulls(1, pa.string()), pa.array([int(counts.sum())])], names=["lang", "size", "phrase", "f"])
            return
        data = np.frombuffer(b"".join(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x, _ in held), np.uint8)
        offsets = np.concatenate([[0], np.flatnonzero(data == 10) + 1]).astype(np.int64)
        phrases = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        table = pa.table({"phrase": phrases, "n": counts}).group_by("phrase").aggregate([("n", "sum")])
        table = table.filter(pc.greater_equal(table["n_sum"], least)).combine_chunks()
        for batch in table.to_batches(max_chunksize=1 << 16):
            own = pc.utf8_rtrim(batch.column("phrase"), characters="\n").cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([size] * len(own), pa.int32()), own, batch.column("n_sum")], names=["lang", "size", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["bin"], row["lang"], row["size"])
                if key != at and held:
                    yield from summed(at[1], at[2], held)
                    held = []
                at = key
                held.append((row["phrases"], row["counts"]))
        if held:
            yield from summed(at[1], at[2], held)

    return sent.repartition("bin").sortWithinPartitions("bin", "lang", "size").mapInArrow(run, GRAMS)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, width: int | None = None) -> DataFrame:
    """Every word and phrase of up to `longest` words that occurs `least` times in its language, counted exactly: lang, size, phrase, f.

    Rows of size 0 without a phrase hold all word occurrences of a language.
    """
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    size = text_bytes(texts)
    width = width_for(size, longest) if width is None else width
    bits = docs.sparkSession.sparkContext.broadcast(sketched(texts, least, longest, width))
    bins = max(BINS, 1 << (size // BIN).bit_length())
    return merged_counts(survivors(texts, bits, longest, width, bins), least)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, subsumed_percent: int = 50, top: int = 2000, width: int | None = None) -> DataFrame:
    """Each language's best collocations: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and
    these into words at spaces and tabs. a, l and r: how often the phrase and
    the two sides of its weakest cut occur in its language; n: all words;
    score: floor(1000000 * a * a / (l * r)), in decimals of 38 digits.
    Phrases of two words or more inside a longer candidate that has
    `subsumed_percent` of their occurrences are dropped.

    Null texts are empty; a null language is `und`. Rows count as often as
    they come. An empty table gives no rows; other columns are not read.

    First pass: tasks fill count-min sketches, whose merged counters are never
    less than the true counts. Second pass: only n-grams that they let through
    are counted, by their strings, first in the task and then by bins of their
    hashes. The sketch's width goes
    with the corpus (or is `width`), up to 128 MB of bits in the second pass;
    a corpus that fills more lets more through, and the second pass counts
    more; the result is the same.
    """
    counts = written(phrase_counts(docs, text, lang, least, longest, width), "phrase-counts")
    candidates = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    side = counts.where("size >= 1")
    left, right = (side.select("lang", F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("first", "l"), ("rest", "r")))
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("_top", wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn("_under", wide("l") * wide("r")).withColumn("score", F.expr("_top div _under"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("size >= 3").select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"), "size")
    inner = inner.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    longer = inner.groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * subsumed_percent))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most candidates: each part of them is ranked first, and the best of all parts together.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
