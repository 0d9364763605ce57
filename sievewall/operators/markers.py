"""Signed markers in review bodies, and the hash of a change that they vouch for, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewall.functions.encoding import hmac_sha256, json_boolean, json_record, json_string, json_strings

#: Whose marker it is: the first word of its line, and of what it signs.
PREFIX, VERSION = "sievewall-review", "v3"
#: White space as Python strips it from an end.
LAST_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+\z"


def marker_pattern(prefix: str = PREFIX) -> str:
    """The marker line at the start of a body: verdict, head, hash of the change, signature."""
    return rf"\A<!-- {prefix}:{VERSION} verdict=(pass|block) head=([0-9a-f]{{40}}) hash=([0-9a-f]{{64}}) mac=([0-9a-f]{{64}}) -->"


def marker_line(verdict: Column, head: Column, own_hash: Column, mac: Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(f"<!-- {prefix}:{VERSION} verdict="), verdict, F.lit(" head="), head, F.lit(" hash="), own_hash, F.lit(" mac="), mac, F.lit(" -->"))


def body_digest(rest: Column) -> Column:
    """SHA-256 of a body behind its marker: line ends made alike, white space at the end gone."""
    return F.sha2(F.regexp_replace(F.regexp_replace(rest, "\r\n?", "\n"), LAST_SPACE, "").cast("binary"), 256)


def signed_list(verdict: Column, repo: Column, number: Column, head: Column, own_hash: Column, rest: Column, prefix: str = PREFIX) -> Column:
    """What a marker signs: a compact JSON list. A repository's name without an owner and a plain name has no list."""
    plain = F.when(repo.rlike("^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$"), F.lower(repo))
    texts = [json_string(x) for x in (F.lit(f"{prefix}-marker"), F.lit(VERSION), verdict, plain)]
    return F.when(plain.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *texts, number.cast("string"), *[json_string(x) for x in (head, own_hash, body_digest(rest))]), F.lit("]")))


def signature(key: bytes, verdict: Column, repo: Column, number: Column, head: Column, own_hash: Column, rest: Column, prefix: str = PREFIX) -> Column:
    return hmac_sha256(key, signed_list(verdict, repo, number, head, own_hash, rest, prefix))


def verified_markers(reviews: DataFrame, key: bytes, prefix: str = PREFIX) -> DataFrame:
    """change_id, review_id, verdict, head, own_hash of reviews whose marker verifies. reviews(change_id, repo, number, review_id, body).

    An empty key verifies nothing.
    """
    pattern, names = marker_pattern(prefix), ("verdict", "head", "own_hash", "mac")
    parts = reviews.where(F.col("body").rlike(pattern)).select("change_id", "repo", "number", "review_id", *[F.regexp_extract("body", pattern, i).alias(n) for i, n in enumerate(names, 1)], F.regexp_replace("body", pattern, "").alias("rest"))
    own = signature(key, F.col("verdict"), F.col("repo"), F.col("number"), F.col("head"), F.col("own_hash"), F.col("rest"), prefix)
    return parts.where((own == F.col("mac")) & F.lit(bool(key))).select("change_id", "review_id", "verdict", "head", "own_hash")


def file_record(body: Column) -> Column:
    """A changed file as canonical JSON: sorted keys, ASCII, `null` for what is not there."""
    texts = {x: json_string(F.col(x)) for x in ("path", "old_path", "status", "old_mode", "new_mode", "content_sha256")}
    return json_record(texts | {"binary": json_boolean(F.col("binary")), "body": json_strings(body)})


def changes_hash(files: DataFrame) -> DataFrame:
    """change_id, own_hash: SHA-256 over the canonical JSON of each file, by path, one a line.

    files(change_id, path, old_path, status, old_mode, new_mode, binary,
    content_sha256, body array<string>). Hunk headers are no part of it, so
    lines that shift elsewhere do not matter.
    """
    records = files.select("change_id", "path", F.coalesce("old_path", F.lit("")).alias("old"), file_record(F.col("body")).alias("record"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "old", "record")))
    lines = F.concat(F.array_join(F.transform(ordered, lambda r: r["record"]), "\n"), F.lit("\n"))
    return records.groupBy("change_id").agg(F.sha2(lines.cast("binary"), 256).alias("own_hash"))
