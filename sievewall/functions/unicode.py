"""Hidden and deceptive Unicode: counters, stripping, folding, the anomaly rule."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code-point ranges of hidden characters by class, for ordinary text.
PROSE_RANGES = {
    "tag": [(0xE0000, 0xE007F), (0xE0100, 0xE01EF)],
    "bidi": [(0x202A, 0x202E), (0x2066, 0x2069)],
    "zw": [(0x200B, 0x200D), (0xFEFF, 0xFEFF)],
    "fmt": [(0x180E, 0x180E), (0x2060, 0x2064), (0x206A, 0x206F)],
}
# What source code adds to each class; format characters come on top, by rule.
CODE_RANGES = {
    "tag": [(0xFE00, 0xFE0F)],
    "bidi": [(0x200E, 0x200F), (0x061C, 0x061C)],
    "zw": [],
    "fmt": [(0x00AD, 0x00AD), (0x2028, 0x2029), (0x034F, 0x034F), (0x115F, 0x1160), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0x180B, 0x180F), (0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)],
}
# Characters that an emoji presentation selector follows in ordinary text.
EMOJI_BASES = [
    (0x0023, 0x0023), (0x002A, 0x002A), (0x0030, 0x0039), (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x203C, 0x203C), (0x2049, 0x2049),
    (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x21AA), (0x231A, 0x23FF), (0x24C2, 0x24C2), (0x25AA, 0x25FE), (0x2600, 0x27BF),
    (0x2934, 0x2935), (0x2B05, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FAFF),
]
CLASSES = ("tag", "bidi", "zw", "fmt")
#: A text is anomalous from so many stripped characters and beyond this share of its length.
LEAST_STRIPPED, SHARE_STRIPPED = 3, 0.001


def _format_characters() -> list[tuple[int, int]]:
    """Ranges of category Cf that no class above names, from this Python's tables."""
    named = [r for own in (PROSE_RANGES, CODE_RANGES) for ranges in own.values() for r in ranges]
    loose = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf" and not any(a <= c <= b for a, b in named)]
    ranges: list[tuple[int, int]] = []
    for c in loose:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1] = (ranges[-1][0], c)
        else:
            ranges.append((c, c))
    return ranges


def ranges_of(profile: str) -> dict[str, list[tuple[int, int]]]:
    """Hidden ranges by class; an unknown profile is an error."""
    if profile == "prose":
        return PROSE_RANGES
    if profile == "code":
        found = {k: PROSE_RANGES[k] + CODE_RANGES[k] for k in CLASSES}
        return found | {"fmt": found["fmt"] + _format_characters()}
    raise ValueError(f"unknown profile {profile!r}")


def character_class(ranges: list[tuple[int, int]]) -> str:
    """A regular expression's class, in the escapes that Java and RE2 share."""
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def patterns(profile: str = "prose") -> dict[str, str]:
    found = {k: character_class(r) for k, r in ranges_of(profile).items()}
    return found | {"any": character_class([r for own in ranges_of(profile).values() for r in own])}


def beyond_ascii(text: Column) -> Column:
    """The characters of a text that are not ASCII, in order. All hidden ones are among them, and long classes are asked about few."""
    return F.regexp_replace(text, r"[\x00-\x7F]++", "")


def hidden_counts(text: Column, profile: str = "prose") -> dict[str, Column]:
    """tag_hits, bidi_hits, zw_hits, fmt_hits and stripped, their sum."""
    own = patterns(profile)
    hits = {f"{k}_hits": F.when(is_ascii(text), 0).otherwise(F.regexp_count(beyond_ascii(text), F.lit(own[k]))).cast("int") for k in CLASSES}
    return hits | {"stripped": sum(hits.values(), F.lit(0)).cast("int")}


def is_ascii(text: Column) -> Column:
    """Whether a text has one byte a character; no hidden character has."""
    return F.octet_length(text) == F.length(text)


def ordinary_selector() -> str:
    """The pattern of an emoji presentation selector in its ordinary place: one, after a base, with no other selector behind."""
    selector = character_class([(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)])
    return f"(?<={character_class(EMOJI_BASES)})[\\x{{FE0E}}\\x{{FE0F}}](?!{selector})"


def has_selector(text: Column) -> Column:
    """Whether a text holds a presentation selector at all; few do, and its pattern looks behind every character."""
    return F.contains(text, F.lit("\ufe0e")) | F.contains(text, F.lit("\ufe0f"))


def exposed_selectors(text: Column) -> Column:
    return F.when(text.isNull() | has_selector(text), F.regexp_count(text, F.lit(ordinary_selector()))).otherwise(0).cast("int")


def hidden_points(text: Column, profile: str = "prose") -> Column:
    """Code points of hidden characters in order, as often as they stand there; source code's ordinary emoji selectors are none."""
    seen = F.when(has_selector(text), F.regexp_replace(text, ordinary_selector(), " ")).otherwise(text) if profile == "code" else text
    found = F.transform(F.regexp_extract_all(beyond_ascii(seen), F.lit(patterns(profile)["any"]), F.lit(0)), F.ascii)
    return F.when(is_ascii(text), F.array().cast("array<int>")).otherwise(found)


def code_point_name(cp: Column) -> Column:
    """U+ and at least four hexadecimal digits."""
    digits = F.hex(cp.cast("long"))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def with_hidden_shown(text: Column) -> Column:
    """Every character that is hidden in source code as <U+XXXX>."""
    # ASCII is told by one range before the long class is asked.
    hidden = r"(?![\x00-\x7F])" + patterns("code")["any"]
    # What stands between hidden characters, one piece more than there are of these, and their names.
    names = F.transform(F.regexp_extract_all(text, F.lit(hidden), F.lit(0)), lambda c: F.concat(F.lit("<"), code_point_name(F.ascii(c)), F.lit(">")))
    shown = F.array_join(F.zip_with(F.split(text, hidden, -1), names, lambda piece, name: F.concat(piece, F.coalesce(name, F.lit("")))), "")
    return F.when(is_ascii(text) | ~beyond_ascii(text).rlike(hidden), text).otherwise(shown)


def _unprintable() -> str:
    """The class of what this Python calls unprintable, unassigned code points and surrogates' places too."""
    ranges: list[tuple[int, int]] = []
    for c in range(0x110000):
        if not chr(c).isprintable() and c != 0x20 and not 0xD800 <= c <= 0xDFFF:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1] = (ranges[-1][0], c)
            else:
                ranges.append((c, c))
    return character_class(ranges)


#: Not printable: controls, format, private use, unassigned, and separators but the blank. The long class is asked only about
#: what the JVM's own categories do not call printable, as they are those of an older Unicode.
UNPRINTABLE = rf"[^\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}} ](?<={_unprintable()})"
#: Of ASCII the controls.
UNPRINTABLE_ASCII = r"[\x00-\x1f\x7f]"


def unprintable_count(text: Column) -> Column:
    return F.when(is_ascii(text), F.regexp_count(text, F.lit(UNPRINTABLE_ASCII))).otherwise(F.regexp_count(text, F.lit(UNPRINTABLE)))


def is_anomalous(stripped: Column, raw_length: Column) -> Column:
    return (raw_length > 0) & (stripped >= LEAST_STRIPPED) & (stripped / raw_length > SHARE_STRIPPED)


def with_slashes_folded(text: Column) -> Column:
    """The fraction and division slashes as /."""
    return F.translate(text, "\u2044\u2215", "//")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def sanitized(docs: DataFrame, text: str = "text", profile: str = "prose") -> DataFrame:
    """The frame with raw_length, the counters, clean (stripped, NFKC, slashes folded) and nfkc_changed.

    NFKC is the one step without a native function. ASCII texts are fixed
    points of it; in their place a null goes to Python, so a frame is read once.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    bare = F.when(is_ascii(raw), raw).otherwise(F.regexp_replace(raw, patterns(profile)["any"], ""))
    counted = docs.withColumns({"raw_length": F.length(raw).cast("int"), **hidden_counts(raw, profile), "_bare": bare})
    folded = with_slashes_folded(nfkc(F.when(~is_ascii(F.col("_bare")), F.col("_bare"))))
    return counted.withColumn("clean", F.coalesce(folded, "_bare")).withColumn("nfkc_changed", F.col("clean") != F.col("_bare")).drop("_bare")
