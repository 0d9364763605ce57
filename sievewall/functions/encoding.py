"""Exact byte encodings as native expressions: a keyed hash, and JSON text in ASCII."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a block of SHA-256.
BLOCK = 64
# The characters that JSON escapes by a letter.
SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary or string message, in hexadecimal: two native hashes over the padded key. Null stays null.

    A key longer than a block is hashed first, as the definition has it.
    """
    own = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in own)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def json_string(text: Column) -> Column:
    """A string as JSON in ASCII: runs of plain characters stay, others are escaped, those beyond 16 bits as two surrogates. Null is `null`."""
    letters = F.create_map(*[F.lit(x) for pair in SHORT_ESCAPES.items() for x in pair])

    def one(token: Column) -> Column:
        units = F.lower(F.hex(F.encode(token, "UTF-16BE")))
        code = F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.substring(units, 5, 4))).otherwise(""))
        return F.when(token.rlike(r"^[ !#-\[\]-~]"), token).otherwise(F.coalesce(F.try_element_at(letters, token), code))

    odd = text.rlike(r"[^ !#-\[\]-~]")
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)[ !#-\[\]-~]+|."), F.lit(0)), one)
    return F.coalesce(F.concat(F.lit('"'), F.when(odd, F.array_join(tokens, "")).otherwise(text), F.lit('"')), F.lit("null"))


def json_record(fields: dict[str, Column]) -> Column:
    """A JSON object of encoded values, its keys in order, a blank behind each colon and comma."""
    parts = [F.concat(json_string(F.lit(name)), F.lit(": "), value) for name, value in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_strings(texts: Column) -> Column:
    """An array of strings as JSON; null is `null`."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(texts, json_string), ", "), F.lit("]")), F.lit("null"))


def json_boolean(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))
