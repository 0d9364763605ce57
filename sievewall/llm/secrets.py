"""Secrets in texts: shaped ones, and strings that pass a battery of randomness tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Fixed patterns of the base kinds, in the order in which they are listed; keywords match in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the randomness tests look at: a run of 20 or more key characters with a digit and a letter in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
#: Encodings, narrowest first: name, pattern of the whole string, alphabet.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Lengths at which a new stratum of the false-discovery control begins.
STRATA = (20, 24, 32, 40, 64, 128)
#: Sums of the squares and of the cubes of the letters' shares in European prose.
LETTER_SQUARES, LETTER_CUBES = 0.068, 0.0058
#: What is made of words changes between lower case, upper case and digits at most so often.
CHANGES_OF_WORDS = 0.25
#: A string that chance would make more rarely than this is not random.
NOT_BY_CHANCE = 0.001
#: Positions are summed up in blocks of so many matches.
BLOCK = 256


def located(matches: Column, between: Column, kind: str, value: Column | None = None) -> Column:
    """Every match as struct(kind, start, end, value) in code points; `value` is an array beside the matches, else they are it.

    The pieces between the matches and the matches themselves add up to the
    text, so positions follow from their lengths. They are summed block by
    block, as an array that grows by one is copied each time.
    """
    spans = "array<struct<kind:string,start:long,end:long,value:string>>"
    empty, none = F.expr("array()").cast(spans), F.expr("array()").cast(f"array<{spans}>")
    steps = F.arrays_zip(F.transform(matches, lambda m: F.length(m).cast("long")).alias("n"), F.transform(between, lambda x: F.length(x).cast("long")).alias("gap"), (matches if value is None else value).alias("v"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda i: F.slice(F.slice(steps, F.lit(1), F.size(matches)), i * BLOCK + 1, F.lit(BLOCK)))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["v"].alias("value"))
        return F.struct((start + x["n"]).alias("at"), F.concat(s["found"], F.array(span)).alias("found"))

    def block(s: Column, x: Column) -> Column:
        own = F.aggregate(x, F.struct(s["at"].alias("at"), empty.alias("found")), step)
        return F.element_at(F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(s["found"], F.array(o["found"])).alias("found"))), 1)

    found = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), block, lambda s: F.flatten(s["found"]))
    return F.when(F.size(matches) > 0, found).otherwise(empty)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal by a logistic fit, within 0.0002 everywhere."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def encoding_of(value: Column) -> Column:
    """The ordinal of the narrowest encoding that holds the string."""
    chosen = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        chosen = F.when(value.rlike(ENCODINGS[i][1]), i).otherwise(chosen)
    return chosen


def word_likeness(value: Column) -> Column:
    """The p-value of "made of words": how often words come out as mixed as this, by two tests together.

    Runs: of lower case, upper case and digits; what is made of words changes
    between them at most CHANGES_OF_WORDS of the time. Chi-squared: the
    letters' counts, either case, against their distribution in prose, by the
    mean and variance of that; it is low where letters are even.
    """
    plain = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    letters = F.lower(F.regexp_replace(value, "[^A-Za-z]", ""))
    counts = F.transform(F.split(F.lit("abcdefghijklmnopqrstuvwxyz"), ""), lambda c: (F.length(letters) - F.length(F.replace(letters, c))).cast("double"))
    s = F.struct(
        F.greatest(F.length(plain) - 1, F.lit(1)).cast("double").alias("steps"),
        (F.regexp_count(classes, F.lit("l+|u+|d+")) - 1).cast("double").alias("changes"),
        F.length(letters).cast("double").alias("m"),
        F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
    )

    def tests(s: Column) -> Column:
        z_runs = (s["changes"] - s["steps"] * CHANGES_OF_WORDS) / F.sqrt(s["steps"] * (CHANGES_OF_WORDS * (1 - CHANGES_OF_WORDS)))
        m = s["m"]
        pairs = m * (m - 1)
        mean = pairs * LETTER_SQUARES
        variance = pairs * (m - 2) * (4 * (LETTER_CUBES - LETTER_SQUARES**2)) + pairs * (2 * (LETTER_SQUARES - LETTER_SQUARES**2))
        z_letters = F.when(m >= 3, (mean - (s["squares"] - m)) / F.sqrt(variance)).otherwise(0.0)
        return upper_tail((z_runs + z_letters) / F.sqrt(F.lit(2.0)))

    return F.element_at(F.transform(F.array(s), tests), 1)


def randomness(value: Column) -> Column:
    """struct(encoding, p): the p-value of "uniformly random in its encoding", the least of three tests, corrected.

    Chi-squared: counts of the alphabet's letters, by Wilson and Hilferty's
    normal approximation. Runs: runs above and below the alphabet's middle,
    Wald and Wolfowitz. Serial correlation: of neighbouring ordinals at lag
    one, which is about normal with variance 1/n. Two sided where both sides
    speak against chance; three tests at once by Sidak.
    """
    which = encoding_of(value)
    alphabet = F.element_at(F.array(*[F.lit(x[2]) for x in ENCODINGS]), which + 1)
    k = F.length(alphabet).cast("double")
    n = F.length(value).cast("double")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(alphabet, c).cast("double"))
    counts = F.transform(F.split(alphabet, ""), lambda c: (F.length(value) - F.length(F.replace(value, c))).cast("double"))
    s = F.struct(codes.alias("codes"), F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"), k.alias("k"), n.alias("n"))

    def tests(s: Column) -> Column:
        n, k, codes = s["n"], s["k"], s["codes"]
        chi = s["squares"] * k / n - n
        df = k - 1
        spread = F.lit(2.0) / (df * 9)
        p_chi = upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread))
        high = F.transform(codes, lambda c: (c > k / 2).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda a, h: a + h).cast("double")
        n2 = n - n1
        runs = F.aggregate(F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda a, b: (a != b).cast("int")), F.lit(1), lambda a, x: a + x).cast("double")
        expected = n1 * n2 * 2 / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = F.when(variance > 0, upper_tail(F.abs(runs - expected) / F.sqrt(variance)) * 2).otherwise(0.0)
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
        centred = F.transform(codes, lambda c: c - mean)
        power = F.aggregate(centred, F.lit(0.0), lambda a, c: a + c * c)
        lagged = F.aggregate(F.zip_with(F.slice(centred, F.lit(1), F.size(centred) - 1), F.slice(centred, F.lit(2), F.size(centred) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        p_serial = F.when(power > 0, upper_tail(F.abs(lagged / power * F.sqrt(n) + F.lit(1.0) / F.sqrt(n))) * 2).otherwise(0.0)
        least = F.least(p_chi, p_runs, p_serial, F.lit(1.0))
        return F.lit(1.0) - F.pow(F.lit(1.0) - least, F.lit(3.0))

    return F.struct(which.alias("encoding"), F.element_at(F.transform(F.array(s), tests), 1).alias("p"))


def stratum(length: Column) -> Column:
    found = F.lit(0)
    for i, least in enumerate(STRATA[1:], 1):
        found = F.when(length >= least, i).otherwise(found)
    return found


def discovery_thresholds(found: DataFrame, rate: float) -> dict[int, float]:
    """Benjamini and Hochberg's threshold of each length stratum, from counts by binned p-value.

    What is reported as random is a discovery; of those, at most `rate` are
    made of words. p-values are rounded up to 1/200 of a decade, so the counts
    are a table of fixed size whatever the number of strings.
    """
    bins = F.least(F.lit(4000), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-20))) * 200)).cast("int")
    counts = found.select(stratum(F.col("length")).alias("stratum"), bins.alias("bin")).groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    ascending = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    ranked = counts.withColumn("rank", F.sum("n").over(ascending)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    top = F.pow(F.lit(10.0), -F.col("bin") / F.lit(200.0))
    rows = ranked.where(top <= F.col("rank") * F.lit(rate) / F.col("all")).groupBy("stratum").agg(F.max(top).alias("most")).collect()
    return {row.stratum: row.most for row in rows}


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = 0.05) -> DataFrame:
    """Secrets of every text: doc_id, base (spans of the base kinds), spans (those and the battery's).

    Spans are struct(kind, start, end) in code points of the whole text, end
    exclusive, by start and then kind as listed (assign, access, hex, random).
    A base span is a whole match. Runs of key characters that no base span
    covers are tested twice: a string is a span of kind `random` if the
    battery does not dismiss chance in its inferred encoding (`randomness`),
    and if words would hardly make it (`word_likeness`), where the share of
    strings made of words among those reported is held under `rate` for each
    length stratum. Null counts as empty; every row gives a row, an empty
    table none; other columns are not read.
    """
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One step each, so that a pattern runs once for its matches and, only where it has some, once for what is between them.
    matched = source.select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()])
    parted = matched.select("doc_id", *[f"m_{k}" for k in patterns], *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"b_{k}") for k, p in patterns.items()])
    value = F.transform("m_assign", lambda m: F.regexp_extract(m, ASSIGN, 2))
    raw = parted.select(
        "doc_id",
        F.filter(located(F.col("m_assign"), F.col("b_assign"), "assign", value), lambda x: F.length(x["value"]) >= 8).alias("assign"),
        *[located(F.col(f"m_{k}"), F.col(f"b_{k}"), k).alias(k) for k in ("access", "hex", "random")],
    )
    base = F.concat("assign", "access", "hex")
    tested = raw.select(
        "doc_id",
        F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(F.lit("assign"), F.lit("access"), F.lit("hex")), x["kind"]).cast("int").alias("ord"), x["end"].alias("end"))).alias("base"),
        F.transform(
            F.filter("random", lambda c: ~F.exists(base, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))),
            lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("ord"), c["end"].alias("end"), F.when(randomness(c["value"])["p"] < NOT_BY_CHANCE, 1.0).otherwise(word_likeness(c["value"])).alias("p")),
        ).alias("candidates"),
    )
    tested = written(tested, "secret-candidates")
    found = tested.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select((F.col("c.end") - F.col("c.start")).alias("length"), F.col("c.p").alias("p"))
    thresholds = discovery_thresholds(found, rate)

    def reported(c: Column) -> Column:
        most = F.lit(-1.0)
        for i, value in thresholds.items():
            most = F.when(stratum(c["end"] - c["start"]) == i, value).otherwise(most)
        return c["p"] <= most

    names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "random")])

    def named(spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda x: F.struct(F.element_at(names, x["ord"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    plain = F.transform(F.filter("candidates", reported), lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end")))
    return tested.select("doc_id", named(F.col("base")).alias("base"), named(F.concat("base", plain)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
