"""License scans: a positional index of each notice's rarest words, intersected by relative position and verified by key phrases."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import PHRASES, TEMPLATES
from .shared import text_slices
from .textarrays import byte_class, flat_text, lowered, span_hashes, word_spans

#: All of ASCII but digits and letters parts words.
GAPS = byte_class(bytes(x for x in range(128) if not chr(x).isalnum()))
SALT = 41
MATCHES = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches array<struct<label:string,first:long,last:long,score:double>>"


def words_of(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def hashed(words: list[str]) -> np.ndarray:
    flat, offsets = flat_text(pa.array(words, pa.string()))
    return span_hashes(flat, offsets[:-1], offsets[1:], SALT)


@dataclass
class Notice:
    """A template by word numbers: what is looked up first, and what verifies it."""

    label: str
    words: np.ndarray
    keys: list[np.ndarray]
    #: Places of its highest-IDF words.
    rare: np.ndarray


class LicenseIndex:
    """The vocabulary of all notices with its IDF over the corpus, and postings of each notice's highest-IDF words.

    A phrase is a notice whose words must all stand in their places; a
    template is looked up by the places of its `rare` highest-IDF words, of
    which half must agree on where it stands, within `slack` words.
    """

    def __init__(self, vocabulary: list[str], idf: np.ndarray, phrases: tuple, templates: tuple, rare: int, slack: int):
        self.slack, self.idf = slack, idf
        number = {w: i for i, w in enumerate(vocabulary)}
        numbers = lambda text: np.array([number[w] for w in words_of(text)], np.int64)
        hashes = hashed(vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.phrases = [Notice(label, numbers(p), [], np.array([int(np.argmax(idf[numbers(p)]))])) for p, label in phrases]
        self.notices = []
        for label, text, keys in templates:
            own = numbers(text)
            best = sorted(set(own.tolist()), key=lambda w: (-idf[w], vocabulary[w]))[:rare]
            self.notices.append(Notice(label, own, [numbers(k) for k in keys], np.flatnonzero(np.isin(own, best))))
        # Postings: of each word number, the notices and places where it is looked up.
        posted = sorted((int(n.words[at]), k, int(at)) for k, n in enumerate(self.notices) for at in n.rare)
        self.post_notice, self.post_place = np.array([x[1] for x in posted], np.int64), np.array([x[2] for x in posted], np.int64)
        self.post_begin = np.searchsorted([x[0] for x in posted], np.arange(len(vocabulary) + 1))

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary; -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    @staticmethod
    def places(words: np.ndarray, phrase: np.ndarray, at: int, candidates: np.ndarray) -> np.ndarray:
        """Where the phrase begins, of the places where its word `at` stands."""
        begins = candidates - at
        begins = begins[(begins >= 0) & (begins + len(phrase) <= len(words))]
        for k, w in enumerate(phrase):
            begins = begins[words[begins + k] == w]
        return begins

    def base(self, words: np.ndarray, texts: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Of each phrase, where it stands: its highest-IDF word is looked up, the others are asked for at their places."""
        known = np.flatnonzero(words >= 0)
        found = []
        for notice in self.phrases:
            at = int(notice.rare[0])
            begins = self.places(words, notice.words, at, known[words[known] == notice.words[at]])
            found.append((notice.label, begins[texts[begins] == texts[begins + len(notice.words) - 1]]))
        return found

    def matches(self, words: np.ndarray, texts: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
        """Verified notices: text, label, first and last word, and the share of the notice's IDF that stands there."""
        known = np.flatnonzero(words >= 0)
        n_posts = np.diff(self.post_begin)[words[known]]
        at = np.repeat(known, n_posts)
        begin = np.cumsum(n_posts) - n_posts
        posts = np.arange(len(at)) - np.repeat(begin - self.post_begin[words[known]], n_posts)
        notice, place = self.post_notice[posts], self.post_place[posts]
        order = np.lexsort((at - place, texts[at], notice))
        at, notice, place = at[order], notice[order], place[order]
        shift = at - place
        new = np.ones(len(at), bool)
        new[1:] = (notice[1:] != notice[:-1]) | (texts[at[1:]] != texts[at[:-1]]) | (np.diff(shift) > self.slack)
        cuts = [*np.flatnonzero(new).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, text = self.notices[notice[a]], int(texts[at[a]])
            if 2 * len(np.unique(place[a:b])) < len(own.rare):
                continue
            first, last = max(int(bounds[text]), int(shift[a])), min(int(bounds[text + 1]), int(shift[b - 1]) + len(own.words))
            window = words[first:last]
            if all(len(self.places(window, key, 0, np.flatnonzero(window == key[0]))) for key in own.keys):
                distinct = np.unique(own.words)
                score = float(self.idf[distinct[np.isin(distinct, window)]].sum() / self.idf[distinct].sum())
                yield text, own.label, first - int(bounds[text]), last - 1 - int(bounds[text]), score


def word_numbers(batch: pa.RecordBatch, of) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word of the texts, and where each text's words begin (n + 1 bounds)."""
    flat, offsets = flat_text(batch.column("text"))
    starts, ends, bounds = word_spans(flat, offsets, GAPS)
    return of(span_hashes(lowered(flat), starts, ends, SALT)), bounds


def license_index(texts: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, rare: int = 8, slack: int = 4) -> LicenseIndex:
    """The index, with the IDF of every word of the notices over all texts. texts: text.

    A task counts in how many of its texts each word stands and sends one row a
    word; nothing that grows with the corpus comes to the driver.
    """
    vocabulary = sorted({w for text in (*[p for p, _ in phrases], *[t for _, t, _ in templates], *[k for _, _, keys in templates for k in keys]) for w in words_of(text)})
    plain = LicenseIndex(vocabulary, np.ones(len(vocabulary)), phrases, templates, rare, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in text_slices(batches, "text"):
            words, bounds = word_numbers(batch, plain.numbered)
            texts_of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            known = words >= 0
            counts += np.bincount(np.unique(texts_of[known] * len(vocabulary) + words[known]) % len(vocabulary), minlength=len(vocabulary))
            n += batch.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(counts[some], n))], names=["word", "n"])

    found = {r.word: r.n for r in texts.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = found.get(-1, 0)
    idf = np.array([math.log((n + 2) / (found.get(w, 0) + 1)) for w in range(len(vocabulary))])
    return LicenseIndex(vocabulary, idf, phrases, templates, rare, slack)


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES, rare: int = 8, slack: int = 4) -> DataFrame:
    """What each whole text holds of licence phrases and notices, by the index of the docs themselves.

    doc_id, n_words; n_base, first_word, last_word: number, smallest and
    largest start of the phrases' places, words from 0; base_labels: the
    phrases' labels; matches: verified notices with their label, first and last
    word and score; labels: those of both, distinct and sorted; score: the best
    match's share of its notice's IDF, 1 where a phrase stands, else 0.

    Words are longest runs of digits, lower-cased letters and all that is not
    ASCII. Phrases are exact. A notice is found where at least half of the
    places of its `rare` highest-IDF words agree on its start within `slack`
    words a step, and all of its key phrases stand there. Null texts are empty
    and hold nothing. A row gives a row; other columns are not read; an empty
    table gives no rows. Words are known by 64-bit digests.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = license_index(own.select("text"), phrases, templates, rare, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words, bounds = word_numbers(batch, index.numbered)
            texts, n = np.repeat(np.arange(batch.num_rows), np.diff(bounds)), batch.num_rows
            n_base, least, most = np.zeros(n, np.int64), np.full(n, len(words)), np.full(n, -1)
            labels, matches = {}, {}
            for label, places in index.base(words, texts):
                np.add.at(n_base, texts[places], 1)
                np.minimum.at(least, texts[places], places)
                np.maximum.at(most, texts[places], places)
                for t in np.unique(texts[places]).tolist():
                    labels.setdefault(t, set()).add(label)
            for t, label, first, last, score in index.matches(words, texts, bounds):
                matches.setdefault(t, []).append({"label": label, "first": first, "last": last, "score": score})
            none = n_base == 0
            columns = [batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(n_base), pa.array(least - bounds[:-1], pa.int64(), mask=none), pa.array(most - bounds[:-1], pa.int64(), mask=none)]
            columns.append(pa.array([sorted(labels.get(t, ())) for t in range(n)], pa.list_(pa.string())))
            kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            columns.append(pa.array([matches.get(t, []) for t in range(n)], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches"])

    found = own.mapInArrow(run, MATCHES)
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("matches.label"))))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0)))
    return found.select("*", labels.alias("labels"), score.alias("score"))
