"""Layers to one fail-closed verdict per document; audit and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewall.functions.credentials import first_rule
from sievewall.functions.encodings import encoded_blobs, encoded_secret
from sievewall.functions.unicode import is_anomalous, sanitized

#: Names of the wrap whose tags a body must not close.
WRAP_TAGS = ("untrusted_external_content", "system-reminder")


def screened(docs: DataFrame, text: str = "text", profile: str = "prose") -> DataFrame:
    """The frame with the deterministic layers' outcomes and the reason that they give, null for a pass.

    Layers in order: hidden Unicode, encoded credentials, plain credentials;
    the first that rejects gives the reason and later ones leave no entry in
    `layers`. A null text counts as empty.
    """
    base = sanitized(docs, text, profile).withColumn("blobs", encoded_blobs(F.col("clean")))
    found = base.withColumns(
        {
            "unicode_reason": F.when(is_anomalous(F.col("stripped"), F.col("raw_length")), F.format_string("unicode_anomaly:stripped=%d/%d", "stripped", "raw_length")),
            "_encoded": encoded_secret(F.col("blobs")),
            "_rule": first_rule(F.col("clean")),
        }
    ).withColumns(
        {
            "encoded_reason": F.when(F.col("_encoded").isNotNull(), F.concat(F.lit("encoded_secret:"), F.col("_encoded.encoding"), F.lit(":"), F.col("_encoded.rule"))),
            "secret_reason": F.concat(F.lit("secret_shape:"), F.col("_rule")),
        }
    )
    return found.withColumn("reason", F.coalesce("unicode_reason", "encoded_reason", "secret_reason")).drop("_encoded", "_rule")


def layer_map(unicode_reason: Column, encoded_reason: Column, secret_reason: Column, blobs: Column) -> Column:
    """What each layer said, up to the one that rejected."""
    encodings = F.array_join(F.array_sort(F.array_distinct(F.transform(blobs, lambda b: b["encoding"]))), ",")
    entries = F.map_from_arrays(
        F.array(F.lit("unicode_sanitize"), F.lit("decode"), F.lit("secret_shapes")),
        F.array(
            F.when(unicode_reason.isNotNull(), "fail").otherwise("pass"),
            F.when(unicode_reason.isNull(), F.concat(F.lit("blobs="), F.size(blobs).cast("string"), F.lit(" encodings="), encodings)),
            F.when(unicode_reason.isNull() & encoded_reason.isNull(), F.coalesce(F.concat(F.lit("fail:"), F.substring_index(secret_reason, ":", -1)), F.lit("pass"))),
        ),
    )
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def audit_rows(verdicts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """What may leave: closed vocabulary and numbers, named one by one; of the text its length only."""
    layers = layer_map(F.col("unicode_reason"), F.col("encoded_reason"), F.col("secret_reason"), F.col("blobs"))
    return verdicts.select(doc_id, F.col("reason").isNull().alias("ok"), F.coalesce("reason", F.lit("pass")).alias("reason"), "raw_length", "stripped", F.length("clean").cast("int").alias("clean_length"), "nfkc_changed", F.size("blobs").alias("blobs"), F.to_json(layers).alias("layers"))


def rejections(verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows for the quarantine sink alone: the first 300 characters and the audit as JSON."""
    audit = audit_rows(verdicts.where("reason is not null").withColumn(doc_id, F.struct(F.col(doc_id), F.substring(F.coalesce(F.col(text), F.lit("")), 1, 300).alias("prompt"))), doc_id)
    return audit.select(f"{doc_id}.{doc_id}", f"{doc_id}.prompt", F.to_json(F.struct(*[x for x in audit.columns if x != doc_id])).alias("verdict"))


def without_wrap_tags(text: Column, tags: tuple[str, ...] = WRAP_TAGS) -> Column:
    """`<` before a tag of the wrap as &lt;, in either case; s and its long form are one letter there."""
    return F.regexp_replace(text, f"(?iu)<(?=\\s*/?\\s*(?:{'|'.join(tags)})\\b)", "&lt;")


def time_bucket(raw_ms: Column, bucket: int = 5000) -> Column:
    """Milliseconds rounded up to whole buckets, one at least."""
    return F.when(raw_ms <= 0, F.lit(bucket)).otherwise((raw_ms + (bucket - 1)) - (raw_ms + (bucket - 1)) % bucket).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters that are no white space, rounded up; U+001C to U+001F are white space too."""
    return F.ceil(F.length(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]", "")) / 4).cast("long")
