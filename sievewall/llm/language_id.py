"""Language identification by unigram piece models, summing over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, text_slices, written
from .textarrays import mix64

SPACE = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Places of a word are looked up in stretches of so many; longer words than that are scored stretch by stretch.
STRETCH = 4096
#: Words are scored together while their characters, padded, times languages and the longest piece are at most so many.
CELLS = 1 << 22
#: A task's table of scored words starts anew beyond so many characters in them.
MOST_CHARACTERS = 4_000_000
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, whole."""
    return LETTERS.findall(text.lower()) if text else []


def vocabulary_of(model_file: str) -> list[str]:
    """The fixed vocabulary: all lower-cased pieces of letters, with or without the mark of a word's start."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return sorted(p for p in pieces if p == SPACE or p.removeprefix(SPACE).isalpha())


class Lattice:
    """All places of vocabulary pieces in words; a character that no piece spells is a piece by itself."""

    def __init__(self, vocabulary: list[str]):
        self.size, self.longest = len(vocabulary) + 1, max(map(len, vocabulary), default=1)
        keys = np.array([self._key(p) for p in vocabulary], np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece = keys[order], order
        self.lengths = sorted({1, *map(len, vocabulary)})

    @staticmethod
    def _key(piece: str) -> int:
        key = np.zeros(1, np.uint64)
        for c in piece:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(c)))
        return int(key[0])

    @staticmethod
    def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """points[place, word]: code points behind the mark of the word's start, zeros behind its end; and sizes with the mark."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        found = np.zeros((len(words), int(sizes.max(initial=1))), np.uint32)
        found[np.arange(found.shape[1]) < sizes[:, None]] = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le"), np.uint32)
        return np.ascontiguousarray(found.T), sizes

    def edges(self, points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each end in order: its edges as (length, words, pieces); every word has an edge of one character at each of its ends."""
        width = len(points)
        for first in range(0, width, STRETCH):
            last = min(width, first + STRETCH)
            base = max(0, first - self.longest + 1)
            own = points[base:last].astype(np.uint64)
            key, found = np.zeros_like(own), {}
            for length in range(1, min(self.longest, len(own)) + 1):
                # key[i] is of the piece that starts at base + i
                key = mix64(key[: len(own) - length + 1] * np.uint64(0x9E3779B97F4A7C15) + own[length - 1 :])
                if length not in self.lengths:
                    continue
                at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[at] == key if len(self.keys) else np.zeros(key.shape, bool)
                inside = np.arange(base + length, last + 1)[:, None] <= sizes
                piece = np.where(hit, self.piece[at] if len(self.keys) else 0, self.size - 1)
                place, word = np.nonzero(inside if length == 1 else hit & inside)
                found[length] = (np.searchsorted(place, np.arange(len(own) - length + 2)), word, piece[place, word])
            for end in range(first + 1, last + 1):
                edges = []
                for length, (cuts, word, piece) in found.items():
                    start = end - length - base
                    if start >= 0 and cuts[start] < cuts[start + 1]:
                        edges.append((length, word[cuts[start] : cuts[start + 1]], piece[cuts[start] : cuts[start + 1]]))
                yield end, edges

    def forward(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """log P(word | language), summed over all segmentations; probability[piece, language].

        Only the sums of the last places that a piece can reach back to are
        kept; they are scaled by the newest, word by word and language by
        language, so that words of any length neither vanish nor cost memory.
        """
        points, sizes = self.points(words)
        shape = (len(words), probability.shape[1])
        ring, scale, found = np.zeros((self.longest + 1, *shape)), np.zeros(shape), np.zeros(shape)
        ring[0] = 1
        for end, edges in self.edges(points, sizes):
            own = ring[end % len(ring)]
            own[:] = 0
            for length, word, piece in edges:
                own[word] += ring[(end - length) % len(ring)][word] * probability[piece]
            done = sizes == end
            found[done] = np.log(own[done]) + scale[done]
            if end % 8 == 0:
                by = np.where(own > 0, own, 1.0)
                scale += np.log(by)
                ring /= by
        return found

    def expected(self, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in one language's words, over all segmentations (forward and backward, in logarithms)."""
        points, sizes = self.points(words)
        n, width = len(words), len(points)
        log_p = np.log(probability)
        alpha, beta = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        edges = list(self.edges(points, sizes))
        for end, own in edges:
            before, total = alpha[end - 1], np.zeros(n)
            for length, word, piece in own:
                total[word] += np.exp(alpha[end - length][word] - before[word]) * probability[piece]
            some = total > 0
            alpha[end][some] = before[some] + np.log(total[some])
        beta[sizes, np.arange(n)] = 0
        whole, counts = alpha[sizes, np.arange(n)], np.zeros(self.size)
        for end, own in reversed(edges):
            for length, word, piece in own:
                step = beta[end][word] + log_p[piece]
                beta[end - length][word] = np.logaddexp(beta[end - length][word], step)
                counts += np.bincount(piece, weights=weights[word] * np.exp(alpha[end - length][word] + step - whole[word]), minlength=self.size)
        return counts

    def batches(self, words: list[str], columns: int) -> Iterator[np.ndarray]:
        """The words' numbers, words of like lengths together, as many as a pass of so many columns holds."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            wide = sizes[order[at:]]
            cells = np.arange(1, len(wide) + 1) * np.maximum(np.minimum(wide, STRETCH), self.longest) * max(columns, 8)
            n = max(1, int(np.searchsorted(cells, CELLS, side="right")))
            yield order[at : at + n]
            at += n


class LanguageModel:
    """Languages, and each piece's probability in each."""

    def __init__(self, languages: list[str], lattice: Lattice, probability: np.ndarray):
        self.languages, self.lattice, self.probability = languages, lattice, probability

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language)."""
        found = np.zeros((len(words), len(self.languages)))
        for part in self.lattice.batches(words, len(self.languages)):
            found[part] = self.lattice.forward([words[k] for k in part.tolist()], self.probability)
        return found


def sampled_words(docs: DataFrame, languages: list[str], share: dict[str, float]) -> DataFrame:
    """Words of a hashed sample of the labelled documents, counted: language (its number), word, n."""
    numbers = F.create_map(*[F.lit(v) for i, x in enumerate(languages) for v in (x, i)])
    limits = F.create_map(*[F.lit(v) for x in languages for v in (x, share[x])])
    part = (F.xxhash64(F.col("doc_id")) % F.lit(1 << 30) + F.lit(1 << 30)) / F.lit(float(1 << 31))
    sample = docs.where(part < F.try_element_at(limits, F.col("lang"))).select(F.try_element_at(numbers, F.col("lang")).alias("language"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        for batch in text_slices(batches, "text"):
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(language, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > 100_000:
                yield from counted_words(counts)
                counts = {}
        yield from counted_words(counts)

    return sample.mapInArrow(run, "language int, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))


def counted_words(counts: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    for language, own in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(own), pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["language", "word", "n"])


def expected_counts(words: DataFrame, lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """Expected counts [piece, language] of all words under the present probabilities, added up from the tasks'."""
    shared = words.sparkSession.sparkContext.broadcast((lattice, probability))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, p = shared.value
        sums = np.zeros(p.shape)
        for batch in text_slices(batches, "word"):
            language, words, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
            for column in np.unique(language).tolist():
                rows = np.flatnonzero(language == column)
                texts = [words[k] for k in rows.tolist()]
                for part in own.batches(texts, 8):
                    sums[:, column] += own.expected([texts[k] for k in part.tolist()], n[rows[part]], p[:, column])
        piece, column = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(column), pa.array(sums[piece, column])], names=["piece", "language", "n"])

    rows = words.mapInArrow(run, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(probability.shape)
    found[rows["piece"].to_numpy(), rows["language"].to_numpy()] = rows["n"].to_numpy()
    return found


def train(labelled: DataFrame, model_file: str, docs_per_language: int = 300, rounds: int = 3, smoothing: float = 0.1) -> LanguageModel | None:
    """Piece probabilities of each language by expectation maximisation; labelled: doc_id, text, lang.

    Only a sample is read in full, chosen by the hash of the id: about
    `docs_per_language` documents of each language. Expected counts are added
    up in the tasks; what comes to the driver is the model's own size, a
    number for each piece and language. None if nothing is labelled.
    """
    labelled = labelled.where("lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    words = written(sampled_words(labelled, languages, {x: docs_per_language / n for x, n in sizes.items()}), "language-words")
    lattice = Lattice(vocabulary_of(model_file))
    probability = np.full((lattice.size, len(languages)), 1.0 / lattice.size)
    for _ in range(rounds):
        counts = expected_counts(words, lattice, probability) + smoothing
        probability = counts / counts.sum(axis=0)
    removed(words)
    return LanguageModel(languages, lattice, probability)


def identify(docs: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of every whole text: doc_id, lang_pred, score.

    A text's probability in a language is the product of its words', each
    summed over all segmentations into pieces, whatever its length; score is
    the posterior of the best language under equal priors, ties to the first
    by name. Texts that
    are null or have no letter are `und` with score 0, as is every text where
    no language was learnt. A row gives a row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[str, int] = {}
        held = 0
        scores = np.zeros((0, len(own.languages) if own else 1))
        for batch in text_slices(batches, "text"):
            words = [words_of(t) if own else [] for t in batch.column("text").to_pylist()]
            if held > MOST_CHARACTERS:
                known, scores, held = {}, scores[:0], 0
            new = list({w for w in chain.from_iterable(words) if w not in known})
            held += sum(map(len, new))
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                scores = np.concatenate([scores, own.word_scores(new)])
            predicted, sure = [], []
            for found in words:
                if not found:
                    predicted.append(UNDETERMINED)
                    sure.append(0.0)
                    continue
                total = scores[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum(axis=0)
                best = int(total.argmax())
                predicted.append(own.languages[best])
                sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(predicted, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
