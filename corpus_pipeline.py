"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, texts become ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewall.llm import exact_dedup, mixing, near_dedup, piece_bpe, queries, toxicity
from sievewall.llm.shared import written

#: A document is rejected from this score on.
TOXIC_FROM = 0.3
#: Documents are near copies from this similarity of their shingles on; so many bands miss a pair at the threshold once in 1.6 million.
NEAR_PERCENT, NEAR_BANDS = 80, 36


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays under the threshold; the model learns from the labels of these documents.

    Each row is judged by its own text, whatever its id.
    """
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, TOXIC_FROM)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for blanks."""
    return exact_dedup.keep_first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, from a similarity of 0.8 on."""
    return near_dedup.keep_one_of_each(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs, queries.table(spark, sf_dir, "labels"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as ids: doc_id, source, ids, n_tokens, decoded (the text that the ids spell)."""
    ids = piece_bpe.encode(docs.select("doc_id", "source", "text"), queries.model_file(), decoded="decoded")
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Training, sketches and tokenisation have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents; each is written and read again as the next one's input."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
