"""Encoded passages: base64, hex and rot13, decoded and put in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .credentials import first_rule
from .unicode import unprintable_count

# How much of a text the reference looks at, what is long enough to decode, and how much of it must be printable.
SCAN_LENGTH, LEAST_INPUT, LEAST_DECODED, PRINTABLE_SHARE = 600_000, 16, 12, 0.90
BASE64, HEX = r"[A-Za-z0-9+/_\-]{24,}={0,2}", r"[0-9a-fA-F]{32,}"
#: Blanks that count as printable.
BLANK = r"[\t\n\r]"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROTATED = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def printable_text(raw: Column) -> Column:
    """Bytes as text if they are valid UTF-8, long enough and printable enough; else null."""
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    odd = unprintable_count(text) - F.regexp_count(text, F.lit(BLANK))
    return F.when((F.octet_length(raw) >= LEAST_DECODED) & (F.length(text) - odd >= F.length(text) * PRINTABLE_SHARE), text)


def decoded_base64(token: Column) -> Column:
    core = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    padded = F.rpad(core, (F.ceil(F.length(core) / 4) * 4).cast("int"), "=")
    return F.when(F.length(core) % 4 != 1, printable_text(F.try_to_binary(padded, F.lit("base64"))))


def decoded_hex(token: Column) -> Column:
    return F.when(F.length(token) % 2 == 0, printable_text(F.unhex(token)))


def encoded_blobs(text: Column, scan_length: int | None = None) -> Column:
    """array<struct<encoding, decoded, excerpt>>: base64 passages in order, then hex, then the whole text by rot13.

    The whole text is scanned, or its first `scan_length` characters where
    they are given (the reference's bound is SCAN_LENGTH). The count is bounded
    by the scanned length alone: a passage takes 17 characters at least.
    """
    scan = text if scan_length is None else F.substring(text, 1, scan_length)

    def blob(encoding: str, decoded: Column, source: Column) -> Column:
        return F.struct(F.lit(encoding).alias("encoding"), decoded.alias("decoded"), F.substring(source, 1, 40).alias("excerpt"))

    found = F.concat(
        F.transform(F.regexp_extract_all(scan, F.lit(BASE64), F.lit(0)), lambda t: blob("base64", decoded_base64(t), t)),
        F.transform(F.regexp_extract_all(scan, F.lit(HEX), F.lit(0)), lambda t: blob("hex", decoded_hex(t), t)),
        F.array(blob("rot13", F.translate(scan, LETTERS, ROTATED), scan)),
    )
    kept = F.filter(found, lambda b: b["decoded"].isNotNull())
    return F.when(F.length(scan) >= LEAST_INPUT, kept).otherwise(F.slice(kept, 1, 0))


def encoded_secret(blobs: Column) -> Column:
    """struct(encoding, rule) of the first passage that hides a credential, or null."""
    hits = F.filter(F.transform(blobs, lambda b: F.struct(b["encoding"].alias("encoding"), first_rule(b["decoded"]).alias("rule"))), lambda h: h["rule"].isNotNull())
    return F.try_element_at(hits, F.lit(1))
