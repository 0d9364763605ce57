"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices, written
from .textarrays import byte_class, flat_text, lowered, prefix_hashes, word_spans

#: Words are runs of ASCII letters, digits, apostrophes and bytes of other scripts; sentences end at these.
ENDINGS = byte_class(b".!?\n\r")
WORD_GAPS = ~byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'" + bytes(range(128, 256)))
#: A word's features are itself and its beginnings of so many bytes, as compounds and endings vary.
PREFIXES = (3, 4, 5, 6)
#: Their hashes fall into so many numbers.
FEATURES = 1 << 19


def instances(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the words, the sentence of each, each sentence's text, and its first and last word's place in bytes.

    Sentences are numbered through the batch; a sentence has a word at least.
    """
    starts, ends, bounds = word_spans(flat, offsets, WORD_GAPS)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    stop = np.cumsum(ENDINGS[flat])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (stop[1:] != stop[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    parts = prefix_hashes(lowered(flat), starts, ends, PREFIXES)
    feature = (np.concatenate([h for _, h in parts]) & np.uint64(FEATURES - 1)).astype(np.int64)
    sentence = number[np.concatenate([w for w, _ in parts])]
    last = np.append(first[1:], len(starts)) - 1
    return feature, sentence, text_of[first], np.stack([starts[first], ends[last]], axis=1) if len(first) else np.zeros((0, 2), np.int64)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class ToxicityModel:
    """A weight for each feature and a bias; a sentence's score is the logistic of the bias and its words' sum."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def sentences(self, feature: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """The logit of each sentence."""
        n = int(sentence.max()) + 1 if len(sentence) else 0
        return np.bincount(sentence, weights=self.weights[feature], minlength=n) + self.bias

    def documents(self, z: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
        """-ln(1 - score) of each of n texts; one without words scores as the bias does."""
        s = np.bincount(text_of, weights=softplus(z), minlength=n)
        s[np.bincount(text_of, minlength=n) == 0] = softplus(np.array([self.bias]))[0]
        return s


def fit(feature: np.ndarray, sentence: np.ndarray, text_of: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int, rate: float, shrink: float) -> ToxicityModel:
    """Proximal Adagrad on the noisy-or likelihood: P(document) = 1 - product over its sentences of (1 - p)."""
    w, bias = np.zeros(FEATURES), -8.0
    square, bias_square = np.full(FEATURES, 1e-8), 1e-8
    total = weight.sum()
    for _ in range(steps):
        z = np.bincount(sentence, weights=w[feature], minlength=len(text_of)) + bias
        s = np.bincount(text_of, weights=softplus(z), minlength=len(label)) + 1e-9
        by_text = weight / total * np.where(label == 1, -1 / np.expm1(np.minimum(s, 500)), 1.0)
        by_sentence = by_text[text_of] / (1 + np.exp(-np.maximum(z, -500)))
        g = np.bincount(feature, weights=by_sentence[sentence], minlength=FEATURES)
        bias_g = by_sentence.sum()
        square += g * g
        bias_square += bias_g * bias_g
        step = rate / np.sqrt(square)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        bias -= rate / np.sqrt(bias_square) * bias_g
    return ToxicityModel(w, bias)


def admitted(sizes: np.ndarray, most: int) -> np.ndarray:
    """Which rows fit into `most` together, taken in their order; one that does not fit is passed over. The shortest if none fits."""
    taken, used = np.zeros(len(sizes), bool), 0
    for i, n in enumerate(sizes.tolist()):
        if used + n <= most:
            taken[i], used = True, used + n
    if len(sizes) and not taken.any():
        taken[int(sizes.argmin())] = True
    return taken


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = 1000, most_features: int = 10_000_000, steps: int = 200, rate: float = 0.5, shrink: float = 2e-4) -> ToxicityModel:
    """Weights from document labels; docs: doc_id, text, and labels: doc_id, label (0 or 1), a row per document.

    Only a sample of rows chosen by the hash of the id is learnt from, each by
    its whole text: about `docs_per_class` documents of each label, and never
    more than twice as many rows, should ids repeat. Rows of one label have
    half of `most_features` features together: in the order of their hashes,
    a row that does not fit any more is passed over (`admitted`). Equal rows
    of one id are one. Rows are weighted back to the labels' true shares. The
    sample is drawn from the labels, so that texts are matched with a small
    table and never shuffled. Without labels, or without toxic ones, no text
    is toxic.
    """
    labels = labels.where("label in (0, 1) and doc_id is not null")
    sizes = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return ToxicityModel(np.zeros(FEATURES), -8.0)
    part = (F.xxhash64(F.col("doc_id")) % F.lit(1 << 30) + F.lit(1 << 30)) / F.lit(float(1 << 31))
    limit = F.when(F.col("label") == 1, docs_per_class / sizes[1]).otherwise(docs_per_class / sizes.get(0, 1))
    sample = written(labels.select(F.col("doc_id").alias("_id"), "label", part.alias("part")).where(F.col("part") < limit), "toxicity-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            feature, sentence, text_of, _ = instances(*flat_text(batch.column("text")))
            order = np.argsort(sentence, kind="stable")
            feature, words = feature[order], np.bincount(sentence, minlength=len(text_of))
            rows = batch.num_rows
            word_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text_of, weights=words, minlength=rows))]).astype(np.int32)), pa.array(feature.astype(np.int32)))
            size_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=rows))]).astype(np.int32)), pa.array(words.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("label"), word_lists, size_lists], names=["part", "label", "words", "sizes"])

    texts = docs.select(F.col("doc_id").alias("_doc_id"), "text")
    picked = texts.join(sample, F.col("_doc_id") == F.col("_id")).select("part", "label", F.coalesce("text", F.lit("")).alias("text"))
    rows = picked.mapInArrow(run, "part double, label int, words array<int>, sizes array<int>")
    rows = written(rows, "toxicity-features")
    keys = ["label", "part", "tie"]
    sized = rows.select("label", "part", F.xxhash64("words", "sizes").alias("tie"), F.size("words").alias("n")).distinct()
    chosen = []
    for value in (0, 1):
        listed = sized.where(F.col("label") == value).orderBy("part", "tie").limit(2 * docs_per_class).collect()
        fits = admitted(np.array([r.n for r in listed], np.int64), most_features // 2)
        chosen += [(r.label, r.part, r.tie) for r, fit_too in zip(listed, fits, strict=True) if fit_too]
    wanted = docs.sparkSession.createDataFrame(chosen, "label int, part double, tie long")
    rows = rows.withColumn("tie", F.xxhash64("words", "sizes")).join(F.broadcast(wanted), keys)
    rows = rows.groupBy(*keys).agg(F.any_value(F.struct("words", "sizes")).alias("f")).select(*keys, "f.*").toArrow().sort_by([(x, "ascending") for x in keys[1:]])
    words, lengths = rows["words"].combine_chunks(), rows["sizes"].combine_chunks()
    label = rows["label"].to_numpy().astype(np.int64)
    words_in = lengths.flatten().to_numpy()
    sentence = np.repeat(np.arange(len(words_in)), words_in)
    text_of = np.repeat(np.arange(len(label)), pc.list_value_length(lengths).to_numpy())
    weight = np.zeros(len(label))
    for value, n in sizes.items():
        weight[label == value] = n / max(1, int((label == value).sum()))
    return fit(words.flatten().to_numpy().astype(np.int64), sentence, text_of, label, weight, steps, rate, shrink)


def toxic_sentences(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every whole text's score, with the sentences that make it: doc_id, score, sentences.

    score is 1 minus the product over the sentences of one minus theirs.
    sentences lists struct(start, end, score), in code points with the end
    exclusive, of the sentences that reach `threshold` themselves, by place.
    Texts that are null, empty or without words have one empty sentence: they
    score as the bias does. A row gives a row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    logit = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, "text"):
            flat, offsets = flat_text(batch.column("text"))
            feature, sentence, text_of, places = instances(flat, offsets)
            z = own.sentences(feature, sentence)
            s = own.documents(z, text_of, batch.num_rows)
            marked = np.flatnonzero(z >= logit)
            owner, spans = text_of[marked], places[marked]
            points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
            at = points[spans] - points[offsets[owner]][:, None]
            column = pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(1 / (1 + np.exp(-z[marked])))], names=["start", "end", "score"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)), column)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(-np.expm1(-s)), lists], names=["doc_id", "score", "sentences"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def below(docs: DataFrame, model: ToxicityModel, most: float, text: str = "text") -> DataFrame:
    """The rows whose whole text scores less than `most`, with all their columns; each row is judged by its own text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, text):
            feature, sentence, text_of, _ = instances(*flat_text(batch.column(text)))
            s = own.documents(own.sentences(feature, sentence), text_of, batch.num_rows)
            yield batch.filter(pa.array(-np.expm1(-s) < most))

    return docs.mapInArrow(run, docs.schema)
