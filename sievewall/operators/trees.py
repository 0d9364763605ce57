"""Documents of nested values as tables of nodes: JSON by levels of variants, YAML by indentation, TOML by statements.

A node has its place (an array: `.key` for a mapping's key, `[n]` for an item),
its type (object, array, string, other) and its value (a string's text, others
as they are written, but for the outermost containers). A document that is not exactly what its reader knows gives one
row of type `unparsed` besides, so that whoever asks can refuse it whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of nesting that are read; deeper documents do not parse.
DEEPEST = 64
# Possessive: Java recurses on a group that it may give back, once for each character.
DOUBLE, SINGLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"'[^']*+(?:''[^']*+)*+'"
NODE = "struct<place:array<string>,type:string,value:string>"
#: Items that a fold gathers before it puts them behind those before.
BLOCK = 64


def exploded(docs: DataFrame, nodes: Column) -> DataFrame:
    own = [x for x in docs.columns if x != "doc"]
    return docs.select(*own, F.explode(nodes).alias("_n")).select(*own, "_n.place", "_n.type", "_n.value")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states of a fold, one after each item. Appending copies an array, so states are gathered in blocks, and blocks in an array of theirs."""
    last = lambda x: F.element_at(x, -1)
    # Each block begins with the state before it.
    of_block = lambda found, block: F.array_append(found, F.aggregate(block, F.array(last(last(found))), lambda s, x: F.array_append(s, step(last(s), x))))
    blocks = bound(items, lambda all_: F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(all_, i, F.lit(BLOCK))))
    return F.filter(F.flatten(F.aggregate(blocks, F.array(F.array(start)), of_block)), lambda _, i: (i > 0) & ((i - 1) % (BLOCK + 1) > 0))


def depth(doc: Column) -> Column:
    """How deep a JSON text's brackets go, those in its strings not counted."""
    brackets = F.regexp_replace(F.regexp_replace(doc, DOUBLE, ""), r"[^\[\]{}]++", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(brackets, ""), start, lambda s, c: F.when(c.isin("[", "{"), F.struct((s["now"] + 1).alias("now"), F.greatest(s["most"], s["now"] + 1).alias("most"))).otherwise(F.struct((s["now"] - F.length(c)).alias("now"), s["most"].alias("most"))), lambda s: s["most"])


def json_nodes(docs: DataFrame, told: Callable[[Column], Column] | None = None) -> DataFrame:
    """The nodes of JSON documents. docs: any columns and doc, the text; its columns stay, doc goes.

    A text is parsed once. Levels are opened in a fold that holds the nodes
    read so far and those of the next level, so that a node is opened once.
    told: of which places, containers are written out as values (all but the
    outermost, if not given); a text within n such containers is n times in the
    nodes, so a caller with deep documents names the few that it reads. A key
    given twice anywhere is no JSON here.
    """
    node = lambda place, v: F.struct(place.alias("place"), v.alias("v"))

    def read(n: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>"))
        return F.struct(n["place"].alias("place"), n["v"].alias("v"), entries.alias("entries"), F.try_variant_get(n["v"], "$", "array<variant>").alias("items"))

    def kept(n: Column) -> Column:
        kind = F.when(n["entries"].isNotNull(), "object").when(n["items"].isNotNull(), "array").when(F.schema_of_variant(n["v"]) == "STRING", "string").otherwise("other")
        shown = (kind == "string") | (F.size(n["place"]) > 1) & (told(n["place"]) | (kind == "other") if told else F.lit(True))
        # As a variant, which is handed on from level to level as it is; a string would be copied.
        return F.struct(n["place"].alias("place"), kind.alias("type"), F.when(shown, n["v"]).alias("v"))

    def inner(n: Column) -> Column:
        of_object = F.transform(n["entries"], lambda e: node(F.array_append(n["place"], F.concat(F.lit("."), e["key"])), e["value"]))
        of_array = F.transform(n["items"], lambda x, i: node(F.array_append(n["place"], F.concat(F.lit("["), i.cast("string"), F.lit("]"))), x))
        return F.coalesce(of_object, of_array, F.array().cast("array<struct<place:array<string>,v:variant>>"))

    def open_level(found: Column, _: Column) -> Column:
        # Bound as the one item of an array: each node is read once, for itself and for what is in it.
        step = F.transform(F.array(F.transform(found["open"], read)), lambda level: F.struct(F.concat(found["done"], F.transform(level, kept)).alias("done"), F.flatten(F.transform(level, inner)).alias("open")))
        return F.when(F.size(found["open"]) > 0, step[0]).otherwise(found)

    def plain(n: Column) -> Column:
        return F.struct(n["place"].alias("place"), n["type"].alias("type"), F.when(n["type"] == "string", F.try_variant_get(n["v"], "$", "string")).otherwise(F.to_json(n["v"])).alias("value"))

    none = F.array().cast("array<string>")
    root = F.struct(F.array().cast("array<struct<place:array<string>,type:string,v:variant>>").alias("done"), F.array(node(none, F.col("v"))).alias("open"))
    unparsed = lambda place: F.struct(place.alias("place"), F.lit("unparsed").alias("type"), F.lit(None).cast("string").alias("value"))
    nodes = F.aggregate(F.sequence(F.lit(0), F.col("deep")), root, open_level, lambda found: F.concat(F.transform(found["done"], plain), F.transform(found["open"], lambda n: unparsed(n["place"]))))
    parsed = docs.withColumns({"v": F.try_parse_json("doc"), "deep": F.least(depth(F.col("doc")), F.lit(DEEPEST))}).drop("doc")
    return exploded(parsed, F.when(F.col("v").isNull(), F.array(unparsed(none))).otherwise(nodes)).drop("v", "deep")


# Fixed formats of YAML's plain scalars: what they may begin with, in flows too, and those that are no strings.
PLAIN_START, FLOW_PLAIN = r"""[^\s"'\[\]{},&*!|>%@`#?:-]|[-:?](?=\S)""", r"""(?:[^\s"'\[\]{},&*!|>%@`#?:-]|[-:?](?=[^\s,\[\]{}]))[^,\[\]{}]*+"""
NO_STRING = r"(?i)^(?:~|null|true|false|yes|no|on|off|[-+]?(?:[0-9][0-9_]*(?:\.[0-9_]*)?(?:e[-+]?[0-9]+)?|\.[0-9]+|0x[0-9a-f]+|\.(?:inf|nan))|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}.*)$"
KEY = rf"(?:{DOUBLE}|{SINGLE}|(?:{PLAIN_START})(?:[^:#\s]|:(?=\S)|(?<=\S)#|[ ](?=\S)(?!#))*+)"
FLOW_KEY = rf"(?:{DOUBLE}|{SINGLE}|[A-Za-z0-9_./@^~<>=*-]++)"
FLOW_VALUE = rf"(?:{DOUBLE}|{SINGLE}|{FLOW_PLAIN})"
#: Mappings may be indented so far, by two blanks a level.
LEVELS = 20


def yaml_scalar(raw: Column) -> Column:
    """struct(type, value) of a scalar as it stands; a null value where its quotes hold what is not known."""
    double, single = raw.startswith('"'), raw.startswith("'")
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    text = F.when(double, F.try_element_at(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(1))).when(single, F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(raw)
    other = ~double & ~single & raw.rlike(NO_STRING)
    return F.struct(F.when(other, "other").otherwise("string").alias("type"), text.alias("value"))


def yaml_nodes(docs: DataFrame) -> DataFrame:
    """The nodes of YAML documents as lockfile writers make them. docs: key columns and doc; the keys must tell documents apart.

    Known are block mappings, two blanks a level, of plain and quoted scalars;
    items of sequences that are scalars; flow mappings and sequences of scalars
    within a line; comments. A line's ancestors are the last keys above it of
    each level less than its own, as far as none of a lower level came after
    them: one fold over the document's lines. Tabs, block scalars, anchors, aliases, tags,
    nested flows, several documents, keys given twice, siblings of several
    indents and children of a scalar make a document `unparsed`.
    """
    keys = [x for x in docs.columns if x != "doc"]
    keyed = rf"^({KEY}) *:(?: +(.*))?$"
    pair = rf"({FLOW_KEY}) *: +({FLOW_VALUE})"

    def told(line: Column) -> Column:
        dash, body = line["line"].rlike(r"^ *- "), F.regexp_replace(line["line"], r"^ *(?:- +)?", "")
        return F.struct(line["pos"].alias("pos"), dash.alias("dash"), F.length(F.regexp_extract(line["line"], "^( *)", 1)).alias("indent"), body.alias("body"), (~dash & body.rlike(keyed)).alias("keyed"))

    def read(x: Column) -> Column:
        raw = F.when(x["keyed"], F.regexp_extract(x["body"], keyed, 2)).otherwise(x["body"])
        # A comment stands behind a blank and outside of quotes; flows with one are left to be refused.
        raw = bound(raw, lambda r: F.when(~F.contains(r, F.lit("#")), r).when(r.rlike(r"""^["']"""), F.regexp_replace(r, rf"^({DOUBLE}|{SINGLE}) +#.*$", "$1")).otherwise(F.regexp_replace(r, "(^| +)#.*$", "")))
        key = F.when(x["keyed"], bound(F.regexp_extract(x["body"], keyed, 1), lambda k: yaml_scalar(k)["value"]))
        return F.struct(x["pos"].alias("pos"), x["dash"].alias("dash"), x["indent"].alias("indent"), (x["indent"] / 2).cast("int").alias("level"), x["keyed"].alias("keyed"), key.alias("key"), F.rtrim(raw).alias("raw"))

    def judged(x: Column) -> Column:
        scalar = x["raw"].rlike(rf"^(?:{DOUBLE}|{SINGLE}|(?:{PLAIN_START})(?:[^:#]++|:(?=\S)|(?<=\S)#)*+)$")
        mapping, sequence = x["raw"].rlike(rf"^\{{ *(?:{pair} *(?:, *(?:{pair}) *)*+)?\}}$"), x["raw"].rlike(rf"^\[ *(?:{FLOW_VALUE} *(?:, *{FLOW_VALUE} *)*+)?\]$")
        kind = F.when(x["keyed"] & (x["raw"] == ""), "empty").when(x["raw"].startswith("{") & mapping, "mapping").when(x["raw"].startswith("[") & sequence, "sequence").when(scalar, "scalar")
        bad = (x["indent"] % 2 != 0) | (x["level"] > LEVELS) | ~(x["keyed"] | x["dash"]) | (x["keyed"] & x["key"].isNull()) | (x["dash"] & x["raw"].rlike(keyed) & ~x["raw"].rlike(r"""^["'\[{]"""))
        return F.struct(*[x[n].alias(n) for n in ("pos", "dash", "level", "keyed", "key", "raw")], kind.alias("kind"), F.coalesce(bad, F.lit(True)).alias("bad"))

    def step(s: Column, x: Column) -> Column:
        own = F.struct(x["level"].alias("level"), x["pos"].alias("pos"), x["key"].alias("key"), F.coalesce(x["kind"] == "empty", F.lit(False)).alias("empty"))
        return F.when(x["keyed"], F.array_append(F.filter(s, lambda e: e["level"] < x["level"]), own)).otherwise(s)

    def below(x: Column, near: Column) -> Column:
        parent = F.try_element_at(near, F.lit(-1))
        own = F.when(x["keyed"], F.concat(F.lit("."), x["key"])).otherwise(F.concat(F.lit("["), x["pos"].cast("string"), F.lit("]")))
        place = F.array_append(F.transform(near, lambda e: F.concat(F.lit("."), e["key"])), own)
        return F.struct(F.coalesce(parent["pos"], F.lit(-1)).alias("parent"), x["level"].alias("level"), x["dash"].alias("dash"), x["raw"].alias("raw"), x["kind"].alias("kind"), (x["bad"] | x["kind"].isNull() | ~F.coalesce(parent["empty"], F.lit(True))).alias("bad"), place.alias("place"))

    def placed(x: Column, s: Column) -> Column:
        return bound(F.filter(s, lambda e: e["level"] < x["level"] + x["dash"].cast("int")), lambda near: below(x, near))

    def nodes(x: Column) -> Column:
        node = lambda place, of: F.struct(place.alias("place"), of["type"].alias("type"), of["value"].alias("value"), (x["bad"] | (of["type"] == "string") & of["value"].isNull()).alias("bad"))
        whole = lambda kind, value: F.struct(x["place"].alias("place"), F.lit(kind).alias("type"), value.alias("value"), x["bad"].alias("bad"))
        inner = F.substring(x["raw"], F.lit(2), F.length(x["raw"]) - 2)
        trimmed = lambda v: bound(F.rtrim(v), yaml_scalar)
        pairs = bound(inner, lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(pair), F.lit(1)).alias("k"), F.regexp_extract_all(t, F.lit(pair), F.lit(2)).alias("v")))
        of_mapping = F.concat(F.array(whole("object", x["raw"])), F.transform(pairs, lambda p: bound(trimmed(p["v"]), lambda v: node(F.array_append(x["place"], F.concat(F.lit("."), yaml_scalar(p["k"])["value"])), v))))
        of_sequence = F.concat(F.array(whole("array", x["raw"])), F.transform(F.regexp_extract_all(inner, F.lit(FLOW_VALUE), F.lit(0)), lambda v, i: bound(trimmed(v), lambda own: node(F.array_append(x["place"], F.concat(F.lit("["), i.cast("string"), F.lit("]"))), own))))
        empty, plain = F.array(whole("object", F.lit(None).cast("string"))), F.transform(F.array(yaml_scalar(x["raw"])), lambda v: node(x["place"], v))
        return F.when(x["kind"] == "empty", empty).when(x["kind"] == "mapping", of_mapping).when(x["kind"] == "sequence", of_sequence).otherwise(plain)

    def of_lines(lines: Column) -> Column:
        """Nodes of a document's lines, and one of no place if siblings differ in their indent or their dash."""
        family = lambda x, *more: F.concat_ws(" ", *[v.cast("string") for v in (x["parent"], *more)])
        mixed = F.size(F.array_distinct(F.transform(lines, lambda x: family(x)))) != F.size(F.array_distinct(F.transform(lines, lambda x: family(x, x["level"], x["dash"]))))
        wrong = F.struct(F.array().cast("array<string>").alias("place"), F.lit("object").alias("type"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("bad"))
        return F.concat(F.flatten(F.transform(lines, nodes)), F.filter(F.array(wrong), lambda _: mixed))

    lines = F.transform(F.split(F.coalesce("doc", F.lit("")), "\r?\n", -1), lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    lines = F.filter(lines, lambda x: ~x["line"].rlike(r"^\s*(?:#.*)?$") & ~((x["pos"] == 0) & (x["line"] == "---")))
    start = F.array().cast("array<struct<level:int,pos:int,key:string,empty:boolean>>")
    read_lines = docs.select(*keys, F.transform(F.transform(F.transform(lines, told), read), judged).alias("_x"))
    rows = read_lines.select(*keys, F.zip_with("_x", running(F.col("_x"), start, step), placed).alias("_x"))
    rows = rows.select(*keys, F.explode(of_lines(F.col("_x"))).alias("n")).select(*keys, "n.*")
    rows = rows.withColumn("bad", F.col("bad") | (F.count(F.lit(1)).over(Window.partitionBy(*keys, "place")) > 1))
    return rows.select(*keys, "place", F.when(F.col("bad"), "unparsed").otherwise(F.col("type")).alias("type"), "value")


# Fixed formats of TOML: a literal string, a bare key, and values that are no strings; escapes of basic strings beyond JSON's.
LITERAL = r"'[^']*+'"
TOML_KEY = rf"(?:{DOUBLE}|{LITERAL}|[A-Za-z0-9_-]++)"
TOML_KEYS = rf"{TOML_KEY}(?: *\. *{TOML_KEY})*+"
TOML_OTHER = r"(?:true|false|[+-]?(?:inf|nan)|[+-]?[0-9][0-9_]*(?:\.[0-9_]+)?(?:[eE][+-]?[0-9_]+)?|0x[0-9A-Fa-f_]+|0o[0-7_]+|0b[01_]+|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})?)?|[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)"


def toml_string(raw: Column) -> Column:
    """The text of a basic or literal string; null for an escape that TOML does not know."""
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    wide = F.regexp_extract_all(inner, F.lit(r"\\U([0-9A-Fa-f]{8})"), F.lit(1))
    # \UXXXXXXXX is none of JSON's escapes: its code point is put in its place; \/ is none of TOML's.
    decoded = F.aggregate(F.array_distinct(wide), raw, lambda s, x: F.replace(s, F.concat(F.lit("\\U"), x), F.coalesce(F.when(F.lower(x) <= "0010ffff", F.decode(F.unhex(x), "UTF-32")), F.lit("\\U"))))
    known = ~F.regexp_replace(inner, r"\\(?:[btnfr\"\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})", "").contains("\\")
    # JSON reads what has neither an escape nor a control character as it stands.
    return F.when(raw.startswith("'") | ~raw.rlike(r"[\\\x00-\x1f]"), inner).when(known, F.try_element_at(F.from_json(F.concat(F.lit("["), decoded, F.lit("]")), "array<string>"), F.lit(1)))


def toml_nodes(docs: DataFrame) -> DataFrame:
    """The strings of TOML documents, quoted keys included, as nodes. docs: key columns and doc; the keys must tell documents apart.

    Lines are joined to statements by a running sum of the brackets that they
    open and close outside of strings and comments. A statement is a header or
    an assignment; a value must reduce to one, from the innermost brackets out,
    without recursion. The table of an assignment is the last header above it
    (its running count, for headers of table arrays). Multi-line strings,
    statements that are neither, and keys or tables given twice make a document
    `unparsed`. place: the header's text and the key.
    """
    token = rf"({DOUBLE}|{LITERAL})"
    header_form = rf"^(\[\[? *)({TOML_KEYS}) *\]\]?$"
    assigned = rf"^({TOML_KEYS}) *= *(.*)$"
    one = r"(?:[SO])"
    array, table = rf"\[ *(?:{one} *(?:, *{one} *)*+(?:, *)?)?\]", rf"""\{{ *(?:(?:""|[A-Za-z0-9_-]+)(?: *\. *(?:""|[A-Za-z0-9_-]+))*+ *= *{one} *(?:, *(?:""|[A-Za-z0-9_-]+)(?: *\. *(?:""|[A-Za-z0-9_-]+))*+ *= *{one} *)*+)?\}}"""
    has = lambda text, *marks: reduce(or_, [F.contains(text, F.lit(m)) for m in marks])
    dotted = lambda name: F.when(has(name, "."), F.regexp_replace(name, r" *\. *", ".")).otherwise(name)

    def line_of(line: Column) -> Column:
        # Strings become an empty pair of quotes each; then what follows a number sign is a comment.
        masked = F.when(has(line, '"', "'"), F.regexp_replace(line, token, '""')).otherwise(line)
        masked = F.when(has(line, "#"), F.regexp_replace(masked, "#.*$", "")).otherwise(masked)
        bare = F.when(has(line, "#"), F.regexp_replace(line, rf"^((?:[^\"'#]++|{DOUBLE}|{LITERAL})*+)#.*$", "$1")).otherwise(line)
        return F.struct(F.rtrim(bare).alias("line"), F.trim(masked).alias("masked"))

    def joined(lines: Column) -> Column:
        """Statements: a line begins one where as many brackets are closed as were opened above it."""
        opened = lambda x: F.length(F.translate(x["masked"], "]}", "")) - F.length(F.translate(x["masked"], "[{", ""))
        depths = lambda deltas: F.concat(F.array(F.lit(0)), running(deltas, F.lit(0), lambda s, d: s + d))
        begins = lambda found: F.filter(F.transform(found, lambda d, i: F.when((d == 0) | (i == F.size(found) - 1), i)), lambda i: i.isNotNull())
        one_of = lambda parts, name: F.trim(F.array_join(F.transform(parts, lambda p: p[name]), " ")).alias("text" if name == "line" else name)
        parted = lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda x, i: bound(F.slice(lines, x + 1, F.get(at, i + 1) - x), lambda parts: F.struct(one_of(parts, "line"), one_of(parts, "masked"))))
        plain = F.transform(lines, lambda x: F.struct(F.trim(x["line"]).alias("text"), x["masked"].alias("masked")))
        return bound(F.transform(lines, opened), lambda deltas: F.when(F.exists(deltas, lambda d: d != 0), bound(bound(depths(deltas), begins), parted)).otherwise(plain))

    def read(s: Column) -> Column:
        header = s["text"].startswith("[[") | s["text"].startswith("[") & s["text"].rlike(r"^\[ *[^\[]")
        value = F.trim(F.regexp_replace(s["masked"], r'^(?:""|[A-Za-z0-9_-]++)(?: *\. *(?:""|[A-Za-z0-9_-]++))*+ *=', ""))
        # Strings are S, other scalars O; the innermost array or inline table becomes O, level by level.
        start = F.regexp_replace(F.regexp_replace(value, '""(?! *=| *\\.)', "S"), rf"(?<![A-Za-z0-9_.+-]){TOML_OTHER}(?![A-Za-z0-9_.+:-])(?! *=)", "O")
        start = F.when(s["masked"].rlike(r'^[A-Za-z0-9_-]++ *= *""$'), "S").otherwise(start)
        return F.struct(s["text"].alias("text"), header.alias("header"), F.when(~header, start).alias("start"))

    def judged(s: Column) -> Column:
        many, text = s["text"].startswith("[["), s["text"]
        reduced = F.when(~has(s["start"], "[", "{"), s["start"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST // 4)), s["start"], lambda x, _: F.when(has(x, "[", "{"), F.regexp_replace(x, f"{array}|{table}", "O")).otherwise(x)))
        well = F.when(s["header"], text.rlike(header_form) & (many == text.endswith("]]"))).otherwise(text.rlike(assigned) & reduced.isin("S", "O"))
        inner_keys = F.transform(F.regexp_extract_all(text, F.lit(r"\{([^{}]*)\}"), F.lit(1)), lambda t: F.regexp_extract_all(t, F.lit(rf"(?:^|,) *({TOML_KEYS}) *="), F.lit(1)))
        twice = has(text, "{") & F.exists(inner_keys, lambda k: F.size(k) != F.size(F.array_distinct(k)))
        name = bound(F.when(s["header"], F.regexp_extract(text, header_form, 2)).otherwise(F.regexp_extract(text, assigned, 1)), dotted)
        strings = F.when(has(text, '"', "'"), F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(1)), toml_string)).otherwise(F.array().cast("array<string>"))
        return F.struct(s["header"].alias("header"), (s["header"] & many).alias("many"), F.coalesce(~well | twice | has(text, '"""', "'''"), F.lit(True)).alias("bad"), name.alias("name"), strings.alias("strings"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.when(x["header"], x["name"]).otherwise(s["table"]).alias("table"), F.when(x["many"], x["name"]).otherwise(s["array"]).alias("array"), (s["instance"] + x["many"].cast("int")).alias("instance"))

    def placed(x: Column, s: Column) -> Column:
        # Tables below an array's element are of that element; others are of the document.
        below = F.coalesce((s["table"] == s["array"]) | F.startswith(s["table"], F.concat(s["array"], F.lit("."))), F.lit(False))
        table = F.coalesce(s["table"], F.lit(""))
        full = F.concat_ws("\n", F.when(below, s["instance"]).otherwise(0).cast("string"), x["header"].cast("string"), table, F.when(~x["header"], x["name"]))
        return F.struct(F.array(F.concat(F.lit("."), table), F.concat(F.lit("."), x["name"])).alias("place"), full.alias("full"), (x["bad"] | F.exists(x["strings"], lambda v: v.isNull())).alias("bad"), x["strings"].alias("strings"))

    wrong = lambda place: F.array(F.struct(place.alias("place"), F.lit("unparsed").alias("type"), F.lit(None).cast("string").alias("value")))

    def nodes(found: Column) -> Column:
        """Strings of all statements, and one node of no place if a key or table is given twice (elements of table arrays differ in their count)."""
        names = F.transform(found, lambda x: x["full"])
        twice = F.size(names) != F.size(F.array_distinct(names))
        of_statement = lambda x: F.when(x["bad"], wrong(x["place"])).otherwise(F.transform(x["strings"], lambda v: F.struct(x["place"].alias("place"), F.lit("string").alias("type"), v.alias("value"))))
        return F.concat(F.flatten(F.transform(found, of_statement)), F.filter(wrong(F.array().cast("array<string>")), lambda _: twice))

    lines = F.filter(F.transform(F.split(F.coalesce("doc", F.lit("")), "\r?\n", -1), line_of), lambda x: x["masked"] != "")
    start = F.struct(F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("array"), F.lit(0).alias("instance"))
    keys = [x for x in docs.columns if x != "doc"]
    statements = docs.select(*keys, lines.alias("_x")).select(*keys, F.transform(F.transform(joined(F.col("_x")), read), judged).alias("_x"))
    found = statements.select(*keys, F.zip_with("_x", running(F.col("_x"), start, step), placed).alias("doc"))
    return exploded(found, nodes(F.col("doc")))
