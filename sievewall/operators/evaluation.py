"""Verdicts against expected labels: attempts, confusion matrix, rates, outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons that tell of an outage, not of the text.
OUTAGE_SUFFIX, OUTAGE_WRAPPERS, OUTAGE_CODES = "_unavailable", ("honeypot", "l2_arbitration"), ("no-key", "key-config-error", "bad-response")


def is_outage(reason: Column) -> Column:
    """Whether a reason's first segment, or the one behind a wrapper, names an outage; counts after + do not matter."""
    parts = F.transform(F.split(reason, ":", -1), lambda s: F.substring_index(s, "+", 1))
    head, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    wrapped = head.isin(*OUTAGE_WRAPPERS) & F.coalesce(F.endswith(second, F.lit(OUTAGE_SUFFIX)), F.lit(False))
    return F.coalesce(F.endswith(head, F.lit(OUTAGE_SUFFIX)) | wrapped | reason.isin(*OUTAGE_CODES), F.lit(False))


def settled_attempts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """id, expected, first_predicted, predicted, attempts: scans are repeated until one agrees, `most` times at most.

    attempts(id, expected, attempt, predicted); later rows than the first
    agreement are not looked at.
    """
    agree = F.col("predicted") == F.col("expected")
    first = F.min(F.when(agree, F.col("attempt")))
    seen = attempts.where(F.col("attempt") <= most)
    stop = seen.groupBy("id").agg(first.alias("stop"), F.max("attempt").alias("all"))
    used = seen.join(stop, "id").where(F.col("attempt") <= F.coalesce("stop", "all"))
    return used.groupBy(*[x for x in ("ord", "id", "expected") if x in used.columns]).agg(
        F.min_by("predicted", "attempt").alias("first_predicted"), F.max_by("predicted", "attempt").alias("predicted"), F.count(F.lit(1)).cast("int").alias("attempts")
    )


def scorecard(results: DataFrame, predicted: str = "predicted") -> DataFrame:
    """One row of counts and rates; block is the positive class, and a rate over nothing is 0."""
    hit, want = F.col(predicted) == "block", F.col("expected") == "block"
    counts = results.agg(F.count_if(hit & want).alias("tp"), F.count_if(~hit & want).alias("fn"), F.count_if(hit & ~want).alias("fp"), F.count_if(~hit & ~want).alias("tn"))

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    rated = counts.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "accuracy": rate(tp + tn, tp + tn + fp + fn), "fp_rate": rate(fp, fp + tn)})
    return rated.withColumn("f1", rate(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def first_attempt_rates(results: DataFrame) -> DataFrame:
    """first_recall and first_fp_rate: how the first scan alone would have done."""
    card = scorecard(results, "first_predicted")
    return card.select(F.col("recall").alias("first_recall"), F.col("fp_rate").alias("first_fp_rate"))


def wrong_ids(results: DataFrame) -> DataFrame:
    """kind, n, ids of the wrong and flaky cases in the order in which they came: fn, fp, flaky (right in the end, but not at first).

    results needs `ord`, the place of a case in its corpus. A list is as long
    as its errors are many.
    """
    kinds = F.array_compact(
        F.array(
            F.when((F.col("expected") == "block") & (F.col("predicted") != "block"), "fn"),
            F.when((F.col("expected") != "block") & (F.col("predicted") == "block"), "fp"),
            F.when((F.col("predicted") == F.col("expected")) & (F.col("first_predicted") != F.col("expected")), "flaky"),
        )
    )
    wrong = results.select(F.explode(kinds).alias("kind"), "ord", "id")
    return wrong.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))


def without_outages(results: DataFrame) -> DataFrame:
    """The results, failing the job at the first outage: an outage is no classification."""
    return results.where(F.assert_true(~is_outage(F.col("reason")), F.lit("a scanner outage is among the results")).isNull())
