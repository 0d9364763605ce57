"""Unified diffs as tables of lines and files, by running sums over each diff's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewall.tables import by_key

FILE = "struct<path:string,old_path:string,status:string,binary:boolean,old_mode:string,new_mode:string,gitlink:boolean,added:array<struct<line_no:long,text:string>>,removed:array<string>,body:array<string>>"
# What follows a backslash in a path that git quotes, as hex of the byte; three octal digits are the other form.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}
# Fixed formats of git's output: a quoted path, a hunk header, and the lines between the file header and its first hunk.
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
HUNK = r"^@@ -[0-9]+(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
HEADERS = (
    ("new file", r"^new file mode "), ("deleted file", r"^deleted file mode "), ("old mode", r"^old mode "), ("new mode", r"^new mode "),
    ("from", r"^(?:rename|copy) from "), ("to", r"^(?:rename|copy) to "), ("before", r"^--- "), ("after", r"^\+\+\+ "),
    ("binary", r"^(?:Binary files |GIT binary patch$)"), ("index", r"^index "), ("similar", r"^(?:dis)?similarity index "),
)
GITLINK = "160000"


def unquoted(name: Column) -> Column:
    """A path without git's quotes: escapes and octal bytes in UTF-8. Null for one that begins with a quote and is not exactly that."""
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    simple = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def as_hex(token: Column) -> Column:
        octal = F.when(token.rlike(r"^\\[0-3][0-7]{2}$"), F.lpad(F.conv(F.substring(token, 2, 3), 8, 16), 2, "0"))
        escape = F.when(F.length(token) == 2, F.try_element_at(simple, F.substring(token, 2, 1)))
        return F.when(token.startswith("\\"), F.coalesce(octal, escape)).otherwise(F.hex(token.cast("binary")))

    parts = F.transform(F.regexp_extract_all(inner, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0)), as_hex)
    raw = F.when(F.forall(parts, lambda x: x.isNotNull()), F.unhex(F.array_join(parts, ""))).cast("string")
    return F.when(~name.startswith('"'), name).when(name.rlike(f"^{QUOTED}$") & F.is_valid_utf8(raw), raw)


def without_prefix(path: Column, prefix: str) -> Column:
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def header_paths(rest: Column) -> Column:
    """struct(old, new) of what follows `diff --git `; null if it is no pair of paths.

    Either may be quoted. Unquoted paths may hold blanks: if both are the
    same, they part in the middle, else at the first ` b/`.
    """
    quoted_first, quoted_last = rest.startswith('"'), rest.endswith('"')
    half = F.floor(F.length(rest) / 2).cast("int")
    same = (F.length(rest) % 2 == 1) & (F.substring(rest, half + 1, F.lit(1)) == " ") & (F.substring(rest, F.lit(3), half - 2) == F.substring(rest, half + 4, half - 2))
    cut = F.instr(rest, " b/")
    first = F.when(quoted_first, F.regexp_extract(rest, f"^({QUOTED}) .*$", 1)).when(quoted_last, F.substring_index(rest, ' "', 1)).when(same, F.substring(rest, F.lit(1), half)).when(cut > 0, F.substring(rest, F.lit(1), cut - 1))
    both = F.transform(F.array(first), lambda x: F.struct(x.alias("a"), F.substring(rest, F.length(x) + 2, F.length(rest)).alias("b")))
    read = F.transform(both, lambda x: F.struct(without_prefix(unquoted(x["a"]), "a/").alias("old"), without_prefix(unquoted(x["b"]), "b/").alias("new")))
    return F.try_element_at(F.filter(read, lambda x: x["old"].isNotNull() & x["new"].isNotNull() & (F.length(first) > 0)), F.lit(1))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Every line of every diff with its place: change_id, pos, line, file (its number, 0 before the first), hunk, inside, start, seen_new, kind, wrong.

    A hunk begins at a line with @@ and holds lines as long as the counts of
    its header, old and new, are not used up. `inside` tells of these; `kind`
    of the others; `wrong` says why no rule explains a line.
    """
    lines = diffs.select("change_id", F.posexplode(F.split(F.regexp_replace("diff", "\n\\z", ""), "\n", -1)).alias("pos", "line")).where("line <> '' or pos > 0")
    order = Window.partitionBy("change_id").orderBy("pos")
    note = F.col("line").startswith("\\")
    numbered = lines.withColumns({"file": F.sum(F.col("line").startswith("diff --git ").cast("int")).over(order), "hunk": F.sum(F.col("line").rlike("^(?:@@|diff --git )").cast("int")).over(order)})
    head = F.first("line").over(Window.partitionBy("change_id", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    numbers = [F.coalesce(F.regexp_extract(head, HUNK, i).try_cast("long"), F.lit(1)) for i in (1, 2, 3)]
    headed = numbered.withColumn("hunked", head.rlike(HUNK) & (F.col("file") > 0)).withColumns({"old": F.when(F.col("hunked"), numbers[0]), "start": F.when(F.col("hunked"), numbers[1]), "new": F.when(F.col("hunked"), numbers[2])})
    opens = F.col("line").rlike("^(?:@@|diff --git )")
    mark = F.substring("line", 1, 1)
    before = Window.partitionBy("change_id", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    counts = ~opens & ~note
    taken = headed.withColumns({"uses_old": (counts & (mark != "+")).cast("int"), "uses_new": (counts & (mark != "-")).cast("int")})
    seen = taken.withColumns({"seen_old": F.coalesce(F.sum("uses_old").over(before), F.lit(0)), "seen_new": F.coalesce(F.sum("uses_new").over(before), F.lit(0))})
    room = F.coalesce(F.col("hunked") & ~opens & ((F.col("seen_old") < F.col("old")) | (F.col("seen_new") < F.col("new"))), F.lit(False))
    kind = F.coalesce(*[F.when(F.col("line").rlike(pattern), name) for name, pattern in (("file", "^diff --git "), ("hunk", "^@@"), *HEADERS)])
    found = seen.withColumn("inside", room & ~note).withColumn("kind", F.when(note & (F.col("file") > 0), "note").when(~room, kind))
    last = Window.partitionBy("change_id", "hunk").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    short = opens & F.coalesce((F.sum("uses_old").over(last) < F.col("old")) | (F.sum("uses_new").over(last) < F.col("new")), F.lit(False))
    follows = F.coalesce(F.max("hunk").over(Window.partitionBy("change_id")) > F.col("hunk"), F.lit(False))
    wrong = (
        F.when(F.col("file") == 0, "content before the first header")
        .when(short, F.when(follows, "bad hunk line").otherwise("truncated hunk"))
        .when(F.col("inside"), F.when(~mark.isin("+", "-", " ", ""), "bad hunk line"))
        .when((F.col("kind") == "hunk") & ~F.col("hunked"), "bad hunk header")
        .when(F.col("kind").isNull(), "unexpected line outside a hunk")
    )
    return found.withColumn("wrong", wrong).select("change_id", "pos", "line", "file", "hunk", "inside", "start", "seen_new", "kind", "wrong")


def parsed_diffs(diffs: DataFrame, change_id: str = "change_id", diff: str = "diff") -> DataFrame:
    """change_id, error, files of each diff; a diff that does not parse has an error and no files.

    Lines end at newlines alone. Of a file's header lines the last of a kind
    counts; a `no newline` note is in the file's body, as it is part of what
    changed, and in no line. A null diff is an empty one. Diffs are dealt by
    their change once, before they are lines, in tasks that no compression
    merges; windows and sums follow without a shuffle.
    """
    source = by_key(diffs.select(F.col(change_id).cast("long").alias("change_id"), F.coalesce(F.col(diff), F.lit("")).alias("diff")), "change_id")
    lines = diff_lines(source)
    value = F.regexp_extract("line", r"^(?:new file mode|deleted file mode|old mode|new mode|(?:rename|copy) (?:from|to)|---|\+\+\+|diff --git) (.*)$", 1)
    side = F.substring_index(value, "\t", 1)
    pair = F.when(F.col("kind") == "file", header_paths(value))
    moved = F.col("kind").isin("from", "to")
    path = F.when(moved, unquoted(value)).when(F.col("kind").isin("before", "after") & (side != "/dev/null"), unquoted(side))
    read = lines.withColumns({"pair": pair, "path": path, "word": F.element_at(F.split("line", " "), -1)})
    bad_path = F.when((F.col("kind") == "file") & F.col("pair").isNull(), "bad file header").when((moved | (F.col("kind").isin("before", "after") & (side != "/dev/null"))) & F.col("path").isNull(), "bad quoted path")
    read = read.withColumn("wrong", F.coalesce("wrong", bad_path))
    kind, pos, p = F.col("kind"), F.col("pos"), F.col("pair")

    def last(value: Column, test: Column) -> Column:
        return F.max_by(F.when(test, value), F.when(test & value.isNotNull(), pos))

    status = F.when(kind == "file", F.when(p["old"] != p["new"], "renamed").otherwise("modified")).when(kind == "new file", "added").when(kind == "deleted file", "deleted").when(kind == "from", "renamed")
    mark, text = F.substring("line", 1, 1), F.substring(F.col("line"), F.lit(2), F.length("line"))
    number = F.col("start") + F.col("seen_new")
    in_body = F.col("inside") | (kind == "note")
    deleted = F.max(F.coalesce(kind == "deleted file", F.lit(False)))
    files = read.groupBy("change_id", "file").agg(
        F.min(F.when(F.col("wrong").isNotNull(), F.struct("pos", "wrong"))).alias("error"),
        last(F.when(kind == "file", p["new"]).when(kind == "to", F.col("path")).otherwise(without_prefix(F.col("path"), "b/")), kind.isin("file", "to", "after")).alias("to_path"),
        last(without_prefix(F.col("path"), "a/"), kind == "before").alias("from_path"),
        last(F.when(kind == "file", F.when(p["old"] != p["new"], p["old"])).otherwise(F.col("path")), kind.isin("file", "from")).alias("old_path"),
        last(status, status.isNotNull()).alias("status"),
        F.max(F.coalesce(kind == "binary", F.lit(False))).alias("binary"),
        last(F.col("word"), kind.isin("deleted file", "old mode")).alias("old_mode"),
        last(F.col("word"), kind.isin("new file", "new mode")).alias("new_mode"),
        (~deleted & F.max(F.coalesce(kind.isin("index") & (F.col("word") == GITLINK), F.lit(False)))).alias("linked"),
        deleted.alias("gone"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("inside") & (mark == "+"), F.struct("pos", number.alias("line_no"), text.alias("text"))))), lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"))).alias("added"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("inside") & (mark == "-"), F.struct("pos", text.alias("text"))))), lambda x: x["text"]).alias("removed"),
        F.transform(F.array_sort(F.collect_list(F.when(in_body, F.struct("pos", "line")))), lambda x: x["line"]).alias("body"),
    )
    final = F.when(F.col("gone"), F.coalesce("from_path", "to_path")).otherwise(F.col("to_path"))
    own = F.struct(final.alias("path"), "old_path", "status", "binary", "old_mode", "new_mode", (F.col("linked") | F.coalesce(F.col("new_mode") == GITLINK, F.lit(False))).alias("gitlink"), "added", "removed", "body")
    whole = files.groupBy("change_id").agg(F.min("error").alias("error"), F.transform(F.array_sort(F.collect_list(F.struct("file", own.alias("f")))), lambda x: x["f"]).alias("files"))
    found = source.select("change_id").join(whole, "change_id", "left")
    none = F.array().cast(f"array<{FILE}>")
    return found.select("change_id", F.col("error.wrong").alias("error"), F.when(F.col("error").isNull(), F.coalesce("files", none)).otherwise(none).alias("files"))


def changed_files(parsed: DataFrame) -> DataFrame:
    """A row per file, in the diff's order: change_id, ord and the file's fields."""
    return parsed.select("change_id", F.posexplode("files").alias("ord", "f")).select("change_id", "ord", "f.*")


def added_lines(files: DataFrame) -> DataFrame:
    """change_id, path, line_no, text of all added lines."""
    return files.select("change_id", "path", F.explode("added").alias("a")).select("change_id", "path", "a.line_no", "a.text")
