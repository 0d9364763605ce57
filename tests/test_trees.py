"""Documents as trees, exact encodings and confined paths, against parsers and encoders of Python's own library, and at lengths that stop a recursive pattern."""

import hashlib
import hmac
import json
import posixpath
import random
import re
import tomllib

import pytest
from pyspark.sql import functions as F

from sievewall.functions import encoding, paths, urls
from sievewall.operators import lockfiles, markers, trees
from sievewall.plans import locks
from sievewall.sources import diffs


def nodes_of(spark, reader, docs):
    found = {k: [] for k in range(len(docs))}
    for r in reader(spark.createDataFrame(list(enumerate(docs)), "k int, doc string")).collect():
        found[r.k].append((tuple(r.place), r.type, r.value))
    return found


def spelt(value, place=()):
    """Every node of a value: place and type, and a string's text."""
    kind = {dict: "object", list: "array", str: "string"}.get(type(value), "other")
    yield place, kind, value if kind == "string" else None
    for name, inner in value.items() if kind == "object" else ((f"[{i}]", x) for i, x in enumerate(value)) if kind == "array" else ():
        yield from spelt(inner, (*place, name if kind == "array" else f".{name}"))


def random_value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return ["", "x\"\\\n", "\U0001f600", 1, 1.5, True, None, "a.b"][rng.randrange(8)]
    if kind == 4:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "", "[0]", ".", "ü", "b c"]): random_value(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_json_nodes_equal_a_walk_of_the_parsed_value(spark):
    rng = random.Random(3)
    values = [random_value(rng, 5) for _ in range(200)] + [[[[[[[[[["deep"]]]]]]]]]]
    for k, found in nodes_of(spark, trees.json_nodes, [json.dumps(v) for v in values]).items():
        own = sorted(((p, t, v if t == "string" else None) for p, t, v in found), key=str)
        assert own == sorted(spelt(values[k]), key=str)


def test_json_that_is_refused(spark):
    deep = lambda n: '{"a":' * n + "1" + "}" * n
    found = nodes_of(spark, trees.json_nodes, ['{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 1}}', "[1", "", None, deep(trees.DEEPEST + 1), deep(trees.DEEPEST)])
    assert ["unparsed" in {t for _, t, _ in found[k]} for k in range(7)] == [True] * 6 + [False]


def test_json_tree_writes_no_container_out_and_deals_its_documents(spark):
    doc = '{"a": [' * 20 + json.dumps("x" * 50_000) + "]}" * 20
    found = nodes_of(spark, lambda docs: trees.json_nodes(docs, told=lambda _: F.lit(False)), [doc])[0]
    assert len(found) == 41 and sum(len(v or "") for _, _, v in found) == 50_000
    assert locks.nested_documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def lock_nodes_of(spark, docs, name):
    files = spark.createDataFrame([(f"{k}/{name}", None, "modified") for k in range(len(docs))], "path string, old_path string, status string")
    heads = spark.createDataFrame([(f"{k}/{name}", doc.encode()) for k, doc in enumerate(docs)], "path string, content binary")
    return lockfiles.lock_nodes(lockfiles.lock_sides(files, heads, heads.where("false")))


def test_nodes_of_a_deep_lockfile_are_as_long_as_the_file(spark):
    resolved = {"x": "y" * 50_000}
    deep = '{"dependencies": {"e": ' * 13 + json.dumps({"resolved": resolved}) + "}}" * 13
    rows = lock_nodes_of(spark, [deep], "package-lock.json").collect()
    assert sum(len(r.value or "") for r in rows) < 3 * len(deep)
    assert [json.loads(r.value) for r in rows if list(r.place)[-1:] == [".resolved"]] == [resolved]


def test_lines_of_lockfiles_are_not_shuffled(spark):
    plan = lock_nodes_of(spark, ["a: b\n"], "pnpm-lock.yaml")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search(r"Exchange hashpartitioning\(path#\d+, kind", plan) and "BroadcastExchange" not in plan


def test_strings_without_a_colon_ask_no_pattern(spark):
    rows = spark.createDataFrame([("x" * 10,), ("http%3A//evil.example",), ("git:x",), ("git@evil.example:x",), (None,)], "t string")
    said = rows.select(urls.bad_urls(F.col("t"), F.array(F.lit("ok"))), lockfiles.spec_findings(F.col("t"))).collect()
    assert [tuple(r) for r in said] == [([], []), ([], []), (["git://x"], ["hosted-git spec git:"]), (["ssh://evil.example"], []), (None, None)]


def test_depth_of_brackets_outside_of_strings(spark):
    docs = spark.createDataFrame([("",), ("1",), ('{"a]]": ["}\\"}}", {"[": 1}], "b": {}}',), ("[" * 100,)], "doc string")
    assert [r[0] for r in docs.select(trees.depth(F.col("doc"))).collect()] == [0, 0, 3, 100]


YAML = {
    "a: 1\nb:\n  c: 'x''y'\n  d:\n    - p\n    - \"q\\u0041\"\ne: [u, 'v', \"w\"]\nf: {g: h, 'i': 2}\n": [((".a",), "other"), ((".b",), "object"), ((".b", ".c"), "string"), ((".b", ".d"), "object"), ((".b", ".d", "[4]"), "string"), ((".b", ".d", "[5]"), "string"), ((".e",), "array"), ((".e", "[0]"), "string"), ((".e", "[1]"), "string"), ((".e", "[2]"), "string"), ((".f",), "object"), ((".f", ".g"), "string"), ((".f", ".i"), "other")],
    "# c\n\na: https://x.y/z#f # note\n'k: 1': \n": [((".a",), "string"), ((".k: 1",), "object")],
    "a:\n- x\n- y\nb: z\n": [((".a",), "object"), ((".a", "[1]"), "string"), ((".a", "[2]"), "string"), ((".b",), "string")],
    "a: {}\nb: []\n": [((".a",), "object"), ((".b",), "array")],
    "": [],
}
NOT_YAML = ["a: 1\na: 2", "a: {x: 1, x: 2}", "a: 1\n  b: 2", "a:\n    b: 1\n  c: 2", "a:\n   b: 1", "a: &x y", "a: *x", "a: !!set x", "a: |\n  b", "a: >-\n  b", "a:\n\tb: 1", "a: {b: {c: d}}", "a: b: c", "a:\n  b: c\n  - d", "a: 'x", 'a: "\\q"', "a: x\n---\nb: y", "? a\n: b", "just words", "a:\n  - b: c", "a: [x\n  , y]", "%YAML 1.2", "a: x\n  continued"]


def test_yaml_nodes(spark):
    found = nodes_of(spark, trees.yaml_nodes, [*YAML, *NOT_YAML])
    for k, wanted in enumerate(YAML.values()):
        assert sorted((p, t) for p, t, _ in found[k]) == sorted(wanted), list(YAML)[k]
    assert {v for _, t, v in found[0] if t == "string"} == {"x'y", "p", "qA", "u", "v", "w", "h"}
    assert [v for p, t, v in found[1] if p == (".a",)] == ["https://x.y/z#f"]
    for k, text in enumerate(NOT_YAML, len(YAML)):
        assert "unparsed" in {t for _, t, _ in found[k]}, text


TOML = [
    'version = 3\n# c "x\n\n[[package]]\nname = "a"\ndeps = [\n "b", # "no"\n "c # d",\n]\n[package.x]\n"q k" = \'l\\t\'\n[[package]]\nname = "b"\n[package.x]\na.b = 1.5\n[metadata]\nh = "\\U0001F600\\n\\u00e4\\"\\\\"\n',
    "a = { b = 'x', c = [ 'y', { d = \"z\" } ] }\ne = 2025-01-01T00:00:00Z\nf = [1, 0x1F, -inf, true, [\"n\"]]\n", "", "a = ''\n", "[a]\nx = 1\n[a.b]\nx = 2\n[c]\nx = 3\n", "a = 'x' # y\r\nb = 1\r\n",
]
NOT_TOML = ["a = 1\na = 2", "a = [1, 2", 'a = "x', "a = x", "[a]\n[a]", "a = {b = 1, b = 2}", 'a = "\\q"', "words", 'a = "x" "y"', "[a", "[[a]", "a = ", "= 1", "a = [1 2]", "a = {b 1}", "a = ]", "a = [{]}", "a b = 1"]


def strings_in(value):
    if isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from strings_in(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings_in(v)
    elif isinstance(value, str):
        yield value


def test_toml_strings_equal_those_of_the_parsed_document(spark):
    found = nodes_of(spark, trees.toml_nodes, [*TOML, *NOT_TOML])
    for k, text in enumerate(TOML):
        assert all(t == "string" for _, t, _ in found[k]), text
        own, wanted = sorted(v for *_, v in found[k]), sorted(strings_in(tomllib.loads(text)))
        plain = [x for x in wanted if not x.replace("_", "").replace("-", "").isalnum()]
        assert set(plain) <= set(own) <= set(wanted), text
    for k, text in enumerate(NOT_TOML, len(TOML)):
        with pytest.raises(tomllib.TOMLDecodeError):
            tomllib.loads(text)
        assert "unparsed" in {t for _, t, _ in found[k]}, text


def test_keyed_hash_and_json_text_are_exact(spark):
    texts = ["", "x", "ü\U0001f600\x00\x1f\x7f\x80\u2028 \"\\/\b\f\n\r\t", "a" * 100_000 + "\n", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in (b"k", b"k" * 63, b"k" * 64, b"k" * 65, bytes(range(256))):
        own = [r[0] for r in frame.select(encoding.hmac_sha256(key, F.col("t"))).collect()]
        assert own == [None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]
    assert [r[0] for r in frame.select(encoding.json_string(F.col("t"))).collect()] == [json.dumps(t) for t in texts]


def test_changes_are_hashed_as_canonical_json(spark):
    names = ["path", "old_path", "status", "old_mode", "new_mode", "binary", "content_sha256", "body"]
    files = [("b\x07", None, "modified", None, None, False, None, ["+\U0001f600", " \"\\"]), ("a", "ü", "renamed", "1", "2", True, "00", []), ("a", None, "added", None, None, None, None, [])]
    frame = spark.createDataFrame([(1, *x) for x in files], "change_id long, path string, old_path string, status string, old_mode string, new_mode string, binary boolean, content_sha256 string, body array<string>")
    said = [json.dumps(dict(zip(names, x, strict=True)), sort_keys=True) + "\n" for x in sorted(files, key=lambda x: (x[0], x[1] or ""))]
    assert markers.changes_hash(frame).first().own_hash == hashlib.sha256("".join(said).encode()).hexdigest()
    assert markers.verified_markers(spark.createDataFrame([], "change_id long, repo string, number int, review_id long, body string"), b"").count() == 0


def test_paths_are_confined(spark):
    rng = random.Random(7)
    names = ["a", "b", "..", ".", "", "..a", "a..", "c d"]
    texts = ["/".join(rng.choice(names) for _ in range(rng.randrange(1, 7))) for _ in range(300)] + ["", None, "/", "\\a", "C:/x", "a\x00", "a/" * 5000 + "z"]
    for text, own in zip(texts, [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(paths.confined(F.col("t"))).collect()], strict=True):
        if text is None or text[:1] == "/" or "\\" in text or "\x00" in text or text[1:2] == ":":
            assert own is None
            continue
        depth, inside = 0, True
        for part in text.split("/"):
            depth += -1 if part == ".." else part not in ("", ".")
            inside &= depth >= 0
        wanted = posixpath.normpath(text)
        assert own == (wanted if inside and wanted != "." and text else None), text


def test_length_stops_no_pattern(spark):
    """A million characters, and two hundred thousand escapes, wherever a text of somebody else's is matched."""
    long, escapes = "x" * 1_000_000, '\\"' * 200_000
    allowed = F.array(F.lit("ok.example"))
    labels = "a." * 300_000
    frame = spark.createDataFrame([(f"git@{labels}c:p",), (f"x@{labels}:p {long}",), (f"https://{long}/{labels}",)], "t string")
    assert [len(r[0]) for r in frame.select(urls.bad_urls(F.col("t"), allowed)).collect()] == [1, 1, 1]
    diff = f'diff --git "a/{long}" "b/{long}"\nold mode 1\nnew mode 2\ndiff --git "a/{escapes}" "b/{escapes}"\nold mode 1\nnew mode 2\n'
    files = diffs.changed_files(diffs.parsed_diffs(spark.createDataFrame([(1, diff)], "change_id long, diff string"))).collect()
    assert [len(r.path) for r in files] == [1_000_000, 200_000]
    pip = f"a==1 --x '{long}' \"{escapes}\" --index-url http://bad.host/\n{'-' + long}\n"
    line = spark.createDataFrame([("r/requirements.txt", 1, x) for x in pip.split("\n")], "path string, line_no long, line string")
    assert [r.detail for r in lockfiles.line_hits(line, True).collect()] == ["line 1: not allowlisted: http://bad.host"]
    docs = {
        "package-lock.json": json.dumps({"x": long, "packages": {"a": {"resolved": "http://bad.host/", "funding": {"url": long}, "license": escapes}}}), "bun.lock": f'{{"x": "{long}{escapes}",}}', "cargo.lock": f'x = "{long}"\ny = [{"1, " * 1000}"{escapes}", "http://bad.host/"]\n',
        "pnpm-lock.yaml": f"a: {long}\nb: '{long}'\nc: \"{escapes}\"\nd: [{long}, http://bad.host/]\n", "yarn.lock": f"? {long}\n",
    }
    files = spark.createDataFrame([(p, None, "modified") for p in docs], "path string, old_path string, status string")
    heads = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in docs.items()], "path string, content binary")
    found = {r.path: r.detail for r in lockfiles.parsed_hits(lockfiles.lock_sides(files, heads, heads.where("false"))).collect()}
    slot = lockfiles.NOT_FETCHABLE
    assert found == {"package-lock.json": f"not allowlisted: {slot}, http://bad.host", "cargo.lock": "not allowlisted: http://bad.host", "pnpm-lock.yaml": "not allowlisted: http://bad.host", "yarn.lock": "lockfile does not parse"}


LOCKS = {
    "npm": ("package-lock.json", {"dependencies": {"a": {"resolved": "https://registry.npmjs.org/a", "dependencies": {"license": {"resolved": "../x", "license": "http://m.x"}}}}, "packages": {"": {"resolved": 5}, "b": {"resolved": "../b", "link": True}, "c": {"license": ["MIT", {"url": "http://m.x", "type": "y"}], "funding": [{"url": "http://f.x", "more": "z"}]}}}, "slot slot http://f.x"),
    "bun": ("bun.lock", {"packages": {"a": ["a@1.0.0", "", {"license": "http://m.x"}, "sha"], "b": ["b@link:../b"], "c": ["c@^1"], "d": [], "e": "x", "f": ["f@1.0.0", "http://t.x/"], "g": [1]}}, "slot slot slot http://t.x"),
    "flake": ("flake.lock", {"nodes": {"n": {"locked": {"type": "github", "host": "GitHub.com"}, "original": {"type": 5}}, "m": {"locked": {"host": "h.x"}}, "root": {}}}, "flake input type 5|flake input type None|flake host h.x"),
}


def test_slots_of_packages(spark):
    files = spark.createDataFrame([(f"{k}/{name}", None, "modified") for k, (name, _, _) in LOCKS.items()], "path string, old_path string, status string")
    heads = spark.createDataFrame([(f"{k}/{name}", bytearray(json.dumps(doc).encode())) for k, (name, doc, _) in LOCKS.items()], "path string, content binary")
    found = {}
    for r in lockfiles.lock_findings(lockfiles.lock_nodes(lockfiles.lock_sides(files, heads, heads.where("false")))).collect():
        found.setdefault(r.path.split("/")[0], []).extend([r.what] * r.n)
    for k, (_, _, wanted) in LOCKS.items():
        told = wanted.split("|") if "|" in wanted else wanted.split(" ")
        assert sorted(found[k]) == sorted(x.replace("slot", lockfiles.NOT_FETCHABLE) if x == "slot" else x for x in told), k


def test_long_documents_are_read_in_one_task_memory_and_states_follow_their_items(spark):
    """Folds over blocks equal a fold item by item, at block ends too; readers neither sort nor window a document's lines to place them."""
    sizes = (0, 1, trees.BLOCK - 1, trees.BLOCK, trees.BLOCK + 1, 5 * trees.BLOCK + 3)
    frame = spark.createDataFrame([(list(range(n)),) for n in sizes], "x array<int>")
    own = [r[0] for r in frame.select(trees.running(F.col("x"), F.lit(5), lambda s, x: s + x)).collect()]
    assert own == [[5 + sum(range(i + 1)) for i in range(n)] for n in sizes]
    docs = spark.createDataFrame([(1, "a: b\n")], "k int, doc string")
    plans = [reader(docs)._jdf.queryExecution().optimizedPlan().toString() for reader in (trees.toml_nodes, trees.yaml_nodes)]
    assert "Window" not in plans[0] and "Aggregate" not in plans[0] and plans[1].count("Window [") == 1
    many = 3000
    yaml = "packages:\n" + "".join(f"  a{i}:\n    r: {{i: x{i}}}\n    cpu:\n      - y{i}\n" for i in range(many))
    found = nodes_of(spark, trees.yaml_nodes, [yaml])[0]
    assert {(p, v) for p, t, v in found if t == "string"} == {((".packages", f".a{i}", ".r", ".i"), f"x{i}") for i in range(many)} | {((".packages", f".a{i}", ".cpu", f"[{4 * i + 4}]"), f"y{i}") for i in range(many)}
    toml = "".join(f"[[p]]\nn = \"k{i}\"\nd = [\n \"a{i}\",\n]\n[p.z]\ny = 'u{i}'\n" for i in range(many))
    found = nodes_of(spark, trees.toml_nodes, [toml, toml + "[p.z]\n"])
    assert {(p, v) for p, _, v in found[0]} == {x for i in range(many) for x in (((".p", ".n"), f"k{i}"), ((".p", ".d"), f"a{i}"), ((".p.z", ".y"), f"u{i}"))}
    assert "unparsed" in {t for _, t, _ in found[1]}


def test_only_nodes_that_tell_something_are_written_and_equal_sides_are_read_once(spark):
    bad, plain = "[[package]]\nname = 'a'\nsource = 'https://evil.example/a'\n", "a = 'b'\n"
    rows = [("same", bad, bad), ("new", bad, plain), ("less", plain, bad), ("again", bad + "c = 'https://evil.example/a'\n", bad), ("torn", "a = ", "a = "), ("mended", plain, "a = "), ("none", None, plain)]
    files = spark.createDataFrame([(f"{k}/Cargo.lock", None, "modified") for k, *_ in rows] + [("y/yarn.lock", None, "modified")], "path string, old_path string, status string")
    classic = "# THIS IS AN AUTOGENERATED FILE.\n# yarn lockfile v1\na@1:\n  version \"1\"\n"
    heads = spark.createDataFrame([(f"{k}/Cargo.lock", head.encode()) for k, head, _ in rows if head] + [("y/yarn.lock", classic.encode())], "path string, content binary")
    bases = spark.createDataFrame([(f"{k}/Cargo.lock", base.encode()) for k, _, base in rows], "path string, content binary")
    sides = lockfiles.lock_sides(files, heads, bases)
    nodes = lockfiles.lock_nodes(sides)
    assert {r.side for r in nodes.where("path = 'same/Cargo.lock'").collect()} == {"both"}
    told = {(r.path.split("/")[0], r.side, r.type) for r in lockfiles.telling(nodes).collect()}
    assert told == {("new", "head", "string"), ("less", "base", "string"), ("again", "head", "string"), ("again", "base", "string"), ("torn", "both", "unparsed"), ("mended", "base", "unparsed"), ("none", "none", "unparsed"), ("y", "head", "unparsed"), ("y", "classic", "unparsed")}
    said = {r.path.split("/")[0]: r.detail for r in lockfiles.parsed_hits(sides).collect()}
    assert said == {"new": "not allowlisted: https://evil.example", "again": "not allowlisted: https://evil.example", "torn": "lockfile does not parse", "none": "lockfile too large to check"}
