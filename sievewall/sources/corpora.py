"""Documents and labelled corpora from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "struct<id:string,text:string,expected:string>"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files: bytes that are no UTF-8 become U+FFFD, line ends become newlines."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("text"))


def valid_case_id(name: Column) -> Column:
    """1 to 64 printable ASCII characters that name a file in the same folder."""
    return F.coalesce(name.rlike(r"\A[ -~]{1,64}\z") & ~name.rlike(r"[/\\]") & ~F.trim(name).isin("", ".", ".."), F.lit(False))


def strict_json(line: Column) -> Column:
    """The line if it is JSON without a key given twice at any depth, else null."""
    return F.when(F.try_parse_json(line).isNotNull(), line)


def labelled_cases(spark: SparkSession, path: str, needs_text: bool = True) -> DataFrame:
    """ord, id, text, expected of files of one JSON object per line; a malformed line fails the job, naming its file and number only.

    A file of labels is read whole, as its lines are numbered; `ord` is the
    place in it.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("at", "value"))
    lines = files.where(~F.col("value").rlike(r"^\s*$")).select(F.concat("file", F.lit(":"), (F.col("at") + 1).cast("string")).alias("file"), F.col("at").alias("ord"), strict_json(F.col("value")).alias("line"))
    cases = lines.select("file", "ord", F.from_json("line", CASE).alias("c"))
    good = F.coalesce(F.col("c").isNotNull() & valid_case_id(F.col("c.id")) & F.col("c.expected").isin("block", "pass"), F.lit(False))
    if needs_text:
        good = good & F.col("c.text").isNotNull()
    return cases.where(F.assert_true(good, F.concat(F.lit("malformed case in "), F.col("file"))).isNull()).select("ord", "c.id", "c.text", "c.expected")


def corpus_folder(spark: SparkSession, folder: str, labels: str = "labels.jsonl") -> DataFrame:
    """Cases of a folder; one without a text takes that of the file it is named after, which must exist."""
    cases = labelled_cases(spark, f"{folder}/{labels}", needs_text=False)
    files = text_files(spark, folder).select(F.substring_index("path", "/", -1).alias("_file"), F.col("text").alias("_file_text"))
    joined = cases.join(files, cases.id == files._file, "left").withColumn("text", F.coalesce("text", "_file_text"))
    return joined.where(F.assert_true(F.col("text").isNotNull(), F.lit("a case has neither a text nor a file")).isNull()).select("ord", "id", "text", "expected")


def bounded_number(value: Column, default: float, low: float, high: float) -> Column:
    """A setting's text as a number between the bounds; what is malformed or not finite is the default."""
    number = value.try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.when(fine, number).otherwise(F.lit(float(default)))))


def allowed_hosts(text: Column) -> Column:
    """Host names, one a line, lower-cased and without a last dot; a line that is none fails the job by its number."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), F.regexp_replace(F.lower(F.trim(x)), r"\.\z", "").alias("host")))
    named = F.filter(lines, lambda x: (x["host"] != "") & ~x["host"].startswith("#"))
    fine = r"\A(?=.{1,253}\z)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?![0-9]+\z)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\z"
    bad = F.filter(named, lambda x: ~x["host"].rlike(fine))
    message = F.concat(F.lit("not a host name in line "), F.try_element_at(bad, F.lit(1))["no"].cast("string"))
    return F.when(F.size(bad) > 0, F.raise_error(message).cast("array<string>")).otherwise(F.transform(named, lambda x: x["host"]))


def exception_globs(text: Column) -> Column:
    """Patterns, one a line; blank lines and those that begin with # are skipped."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
