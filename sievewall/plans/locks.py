"""Queries over lockfiles as trees, signed markers, the hash of a change, and local paths."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewall.functions import encoding, paths
from sievewall.operators import lockfiles, markers, trees
from sievewall.tables import spread

from .changes import lock_file_rows
from .fixtures import LITERALS, choice, table

#: A string so long that a pattern which recurses by character would end the task.
LONG = 200_000
# Fixed inputs: how a TOML lockfile says where a package is from, with what is wrong about it.
TOML_SOURCES = (
    ('source = "registry+https://github.com/rust-lang/crates.io-index"', None), ('source = "git+https://evil.example/r?rev=1#abc" # note', "git+https://evil.example"), ('sdist = { url = "https://files.pythonhosted.org/a", size = 1 }', "https://files.pythonhosted.org"),
    ('wheels = [\n    { url = "https://static.crates.io/a", hash = "sha256:0" },\n    { url = "http://evil.example/b" },\n]', "http://evil.example"), ("url = 'https://evil.example/\\x'", "https://evil.example"), ('description = "a \\"b\\" # c \\u00e4 \\U0001F600"', None),
    ('name = "again"', "!"), ('note = "cut', "!"), ('note = """many\nlines"""', "!"), ('a.b = 1.5\na."c d" = [1, [true, "x"], 2025-01-01T00:00:00Z,]', None),
)
# The same for pnpm: the lines of a package entry.
YAML_ENTRIES = (
    ("resolution: {integrity: sha512-x==}\n    engines: {node: '>=18'}", None), ("resolution: {tarball: https://evil.example/a.tgz}", "https://evil.example"), ("resolution: {tarball: ../a.tgz}", "slot"), ("resolution: {repo: r, type: git}", "slot"), ("resolution: {type: directory, directory: ../a}", None),
    ("resolution: {type: directory, directory: /abs}", "slot"), ("deprecated: see https://evil.example/x", None), ("dependencies:\n      b: github:o/r#1", "hosted-git spec github:"), ("resolution: {integrity: a, integrity: b}", "!"), ("resolution: &x {integrity: a}", "!"),
    ("cpu:\n      - x64\n      - 'arm''64'\n    os: [a, \"b\"]", None), ("resolution:\n      tarball: 'http://evil.example/a.tgz'", "http://evil.example, slot"), ("funding: {url: http://evil.example, type: x}", None), ("funding: {url: http://evil.example, more: x}", "http://evil.example"),
)
# npm's older dependencies, one within the other.
NESTED = ("https://registry.npmjs.org/d.tgz", "http://evil.example/d.tgz", "../d", "file:../d", "github:o/r")


def toml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_partkey").cast("string")
    long = F.when(key % 199 == 0, F.concat(F.lit('\nlong = "'), F.repeat(F.lit("x"), LONG), F.lit('"'))).otherwise("")
    doc = F.concat(F.lit('version = 3\n\n[[package]]\nname = "a'), name, F.lit('"\n'), choice([x for x, _ in TOML_SOURCES], key), long, F.lit("\n\n[package.more]\nx = 1\n\n[[package]]\nname = 'b'\n\n[package.more]\nx = 1\n"))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("t"), name, F.lit("/Cargo.lock")).alias("path"), doc.alias("head"), F.when(key % 3 == 0, doc).alias("base"))


def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_partkey").cast("string")
    doc = F.concat(F.lit("lockfileVersion: '9.0'\n\nimporters:\n  .:\n    dependencies:\n      a:\n        specifier: ^1.0.0\n        version: 1.0.0\n\npackages:\n\n  a@1.0."), name, F.lit(":  # the entry\n    "), choice([x for x, _ in YAML_ENTRIES], key), F.lit("\n\n  '@s/b@2.0.0':\n    hasBin: true\n"))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("y"), name, F.lit("/pnpm-lock.yaml")).alias("path"), doc.alias("head"), F.when(key % 3 == 0, doc).alias("base"))


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies within dependencies, one to thirteen deep, with a package named license whose spec is no metadata."""
    key, name = F.col("p_partkey"), F.col("p_partkey").cast("string")
    depth = (key % 13).cast("int")
    inner = F.concat(F.lit('"d": {"resolved": "'), choice(NESTED, key), F.lit('", "license": "https://evil.example/l", "requires": {"license": "'), F.when(key % 4 == 0, "github:o/license").otherwise("^1.0.0"), F.lit('"}'), F.when(key % 199 == 0, F.concat(F.lit(', "x": "'), F.repeat(F.lit("x\\\\"), LONG), F.lit('"'))).otherwise(""), F.lit("}"))
    doc = F.concat(F.repeat(F.lit('{"dependencies": {"e": '), depth), F.lit('{"dependencies": {'), inner, F.lit("}}"), F.repeat(F.lit("}}"), depth))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("n"), name, F.lit("/package-lock.json")).alias("path"), doc.alias("head"), F.when(key % 3 == 0, doc).alias("base"))


def toml_lock_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfiles.parsed_hits(lockfiles.lock_sides(*lock_file_rows(toml_documents(spark, sf_dir))))


def yaml_lock_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfiles.parsed_hits(lockfiles.lock_sides(*lock_file_rows(yaml_documents(spark, sf_dir))))


def nested_lock_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfiles.parsed_hits(lockfiles.lock_sides(*lock_file_rows(nested_documents(spark, sf_dir))))


def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the nested documents."""
    docs = nested_documents(spark, sf_dir).select("path", F.col("head").alias("doc"))
    return trees.json_nodes(docs, told=lambda _: F.lit(False)).select("path", F.array_join("place", "").alias("place"), "type", F.when(F.col("type") == "string", F.sha2("value", 256)).alias("value_sha256"))


#: Longer than a block of the hash, so that it is hashed itself.
KEY = b"0123456789abcdef" * 5
TAILS = ("", "\r\n\t ", "x")


def signed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as reviews, signed; a third has white space put at its end since, a third a letter."""
    turn = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("change_id"), F.col("turn").cast("long").alias("review_id"), F.lit("Own/Repo").alias("repo"), F.col("conv_id").alias("number"), F.when(F.col("turn") % 2 == 0, "pass").otherwise("block").alias("verdict"),
        F.substring(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256), 1, 40).alias("head"), F.sha2(F.coalesce("role", F.lit("")).cast("binary"), 256).alias("own_hash"), F.concat(F.lit("\r\n"), F.coalesce("text", F.lit(""))).alias("rest"),
    )
    mac = markers.signature(KEY, F.col("verdict"), F.col("repo"), F.col("number"), F.col("head"), F.col("own_hash"), F.col("rest"))
    tail = choice(TAILS, F.col("review_id"))
    return turn.withColumn("mac", mac).withColumn("body", F.concat(markers.marker_line(F.col("verdict"), F.col("head"), F.col("own_hash"), F.col("mac")), "rest", tail))


def marker_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed_reviews(spark, sf_dir).select("change_id", "review_id", "mac")


def verified_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.verified_markers(signed_reviews(spark, sf_dir), KEY)


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as changed files, four a change, with texts whose escapes need one and two units."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.floor(key / 4).cast("long").alias("change_id"), F.concat(F.lit("d/ü\U0001f600\x7f\t"), key.cast("string")).alias("path"), F.when(key % 3 == 0, 'o"\\').alias("old_path"), F.lit("modified").alias("status"), F.lit(None).cast("string").alias("old_mode"), F.lit("100644").alias("new_mode"),
        (key % 5 == 0).alias("binary"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_sha256"), F.split(F.concat(F.lit("+"), F.coalesce("text", F.lit(""))), "\n", -1).alias("body"),
    )


def changes_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.changes_hash(changed_documents(spark, sf_dir))


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('"\\\b\f\x00\x1f\x7f é\U0001f600 '), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(encoding.json_string(text).cast("binary"), 256).alias("json_sha256"))


# Beginnings of paths, each with where it leads, the page's name behind it.
PLACES = (("", ""), ("a/../", ""), ("./x//", "x/"), ("a/b/../../", ""), ("a/b/../c/./", "a/c/"), ("../", None), ("a/../../b/", None), ("a/b/../../../c/", None), ("/", None), ("C:/", None), ("a\\..\\", None), ("a/..b/...//", "a/..b/.../"))


def confined_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted paths below a root of stored pages, hostile ones among them: what they lead to, and what is there."""
    key = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    wanted = pages.select(key.alias("change_id"), F.concat(choice([x for x, _ in PLACES], key), F.lit("p"), key.cast("string")).alias("path"))
    stored = pages.where("page_id % 2 = 0").select(F.concat(F.lit("p"), key.cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    return paths.local_contents(wanted, stored).select("change_id", paths.confined(F.col("path")).alias("place"), F.sha2("content", 256).alias("content_sha256"))


QUERIES = (toml_lock_findings, yaml_lock_findings, nested_lock_findings, json_tree, marker_signatures, verified_markers, changes_hash, json_texts, confined_paths)

L = LITERALS
SLOT = lockfiles.NOT_FETCHABLE


def found_by_turns(name: str, outcomes: list[str | None]) -> str:
    """Paths with what is wrong by turns: nothing where the base is the head, `!` for what does not parse."""
    said = ", ".join("NULL" if x is None else "'" + x.replace("slot", SLOT) + "'" for x in outcomes)
    return f"""SELECT path, CASE WHEN w = '!' THEN 'lockfile does not parse' ELSE 'not allowlisted: ' || array_to_string(list_sort(string_split(w, ', ')), ', ') END AS detail
        FROM (SELECT '{name[0]}' || p_partkey || '/{name[1:]}' AS path, [{said}][p_partkey % {len(outcomes)} + 1] AS w, p_partkey % 3 = 0 AS same FROM part) WHERE w IS NOT NULL AND (w = '!' OR NOT same)"""


ESCAPED = r"""array_to_string(list_transform(regexp_extract_all(@T, '(?s).'), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t'
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN '\u' || printf('%04x', unicode(c)) ELSE '\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || '\u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) END), '')"""
PADDED = hashlib.sha256(KEY).digest().ljust(64, b"\0")
PADS = [bytes(x ^ pad for x in PADDED).hex().upper() for pad in (0x36, 0x5C)]
REVIEWS = rf"""
turns AS (SELECT conv_id AS change_id, CAST(turn AS BIGINT) AS review_id, CASE WHEN turn % 2 = 0 THEN 'pass' ELSE 'block' END AS verdict, substr(sha256(CAST(conv_id AS VARCHAR)), 1, 40) AS head, sha256(coalesce(role, '')) AS own_hash,
  regexp_replace(regexp_replace(chr(13) || chr(10) || coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '') AS rest FROM conversations),
signed AS (SELECT *, sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode('["sievewall-review-marker","v3","' || verdict || '","own/repo",' || change_id || ',"' || head || '","' || own_hash || '","' || sha256(rest) || '"]')))) AS mac FROM turns)
"""
SQL = {
    "toml_lock_findings": found_by_turns("tCargo.lock", [x for _, x in TOML_SOURCES]),
    "yaml_lock_findings": found_by_turns("ypnpm-lock.yaml", [x for _, x in YAML_ENTRIES]),
    "nested_lock_findings": f"""WITH w AS (SELECT p_partkey AS k, unnest(list_filter([CASE WHEN p_partkey % 5 = 1 THEN 'http://evil.example' END, CASE WHEN p_partkey % 5 IN (1, 2, 4) THEN '{SLOT}' END, CASE WHEN p_partkey % 5 = 4 OR p_partkey % 4 = 0 THEN 'hosted-git spec github:' END], lambda x: x IS NOT NULL)) AS what FROM part WHERE p_partkey % 3 <> 0)
        SELECT 'n' || k || '/package-lock.json' AS path, 'not allowlisted: ' || string_agg(what, ', ' ORDER BY what) AS detail FROM w GROUP BY k""",
    "json_tree": f"""WITH d AS (SELECT p_partkey AS k, 'n' || p_partkey || '/package-lock.json' AS path, CAST(p_partkey % 13 AS INTEGER) AS depth, {L(NESTED)}[p_partkey % {len(NESTED)} + 1] AS r FROM part),
        o AS (SELECT path, repeat('.dependencies.e', i) AS place FROM d, range(0, 14) t(i) WHERE i <= depth UNION ALL SELECT path, repeat('.dependencies.e', i) || '.dependencies' FROM d, range(0, 14) t(i) WHERE i <= depth
          UNION ALL SELECT path, repeat('.dependencies.e', depth) || unnest(['.dependencies.d', '.dependencies.d.requires']) FROM d),
        s AS (SELECT path, repeat('.dependencies.e', depth) || '.dependencies.d' AS e, k, r FROM d)
        SELECT path, place, 'object' AS type, NULL AS value_sha256 FROM o UNION ALL SELECT path, e || '.resolved', 'string', sha256(r) FROM s UNION ALL SELECT path, e || '.license', 'string', sha256('https://evil.example/l') FROM s
        UNION ALL SELECT path, e || '.requires.license', 'string', sha256(CASE WHEN k % 4 = 0 THEN 'github:o/license' ELSE '^1.0.0' END) FROM s UNION ALL SELECT path, e || '.x', 'string', sha256(repeat('x\\', {LONG})) FROM s WHERE k % 199 = 0""",
    "marker_signatures": f"WITH {REVIEWS} SELECT change_id, review_id, mac FROM signed",
    "verified_markers": f"WITH {REVIEWS} SELECT change_id, review_id, verdict, head, own_hash FROM signed WHERE review_id % 3 <> 2",
    "changes_hash": f"""WITH f AS (SELECT doc_id // 4 AS change_id, 'd/' || chr(252) || chr(128512) || chr(127) || chr(9) || doc_id AS path, doc_id % 3 = 0 AS moved, doc_id % 5 = 0 AS binary_file, coalesce(text, '') AS text FROM documents),
        r AS (SELECT change_id, path, moved, '{{"binary": ' || CASE WHEN binary_file THEN 'true' ELSE 'false' END || ', "body": [' || array_to_string(list_transform(string_split('+' || text, chr(10)), lambda line: '"' || {ESCAPED.replace("@T", "line")} || '"'), ', ') || '], "content_sha256": "' || sha256(text)
          || '", "new_mode": "100644", "old_mode": null, "old_path": ' || CASE WHEN moved THEN '"o\\"\\\\"' ELSE 'null' END || ', "path": "' || {ESCAPED.replace("@T", "path")} || '", "status": "modified"}}' AS record FROM f)
        SELECT change_id, sha256(string_agg(record, chr(10) ORDER BY path) || chr(10)) AS own_hash FROM r GROUP BY change_id""",
    "json_texts": f"""WITH t AS (SELECT doc_id, '"\\' || chr(8) || chr(12) || chr(0) || chr(31) || chr(127) || ' ' || chr(233) || chr(128512) || ' ' || coalesce(text, '') AS text FROM documents) SELECT doc_id, sha256('"' || {ESCAPED.replace("@T", "text")} || '"') AS json_sha256 FROM t""",
    "confined_paths": f"""WITH p AS (SELECT page_id AS change_id, [{", ".join("NULL" if y is None else f"'{y}'" for _, y in PLACES)}][page_id % {len(PLACES)} + 1] || 'p' || page_id AS place FROM pages)
        SELECT change_id, place, CASE WHEN place = 'p' || change_id AND change_id % 2 = 0 THEN sha256(html) END AS content_sha256 FROM p JOIN pages ON page_id = change_id""",
}
