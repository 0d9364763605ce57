"""Lockfiles by tables of strings: what a change newly fetches from places that are not allowed.

JSON, TOML and YAML lockfiles become nodes (`trees`), and those rows of strings
and fetch slots; pip's files and other formats are read by their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewall.functions.urls import bad_urls
from sievewall.operators.gate import lockfile_kind, logical_lines, new_lines
from sievewall.operators.trees import json_nodes, toml_nodes, yaml_nodes
from sievewall.tables import by_key, written

# The hosts that each lockfile fetches from.
NPM, PYPI = ("registry.npmjs.org", "registry.yarnpkg.com"), ("pypi.org", "files.pythonhosted.org")
HOSTS = {
    "package-lock.json": NPM, "npm-shrinkwrap.json": NPM, "yarn.lock": NPM, "pnpm-lock.yaml": NPM, "bun.lock": NPM,
    "cargo.lock": ("github.com", "index.crates.io", "static.crates.io"), "uv.lock": PYPI, "poetry.lock": PYPI, "pipfile.lock": PYPI, "pdm.lock": PYPI, "requirements": PYPI,
    "flake.lock": ("github.com", "channels.nixos.org", "releases.nixos.org"), "gemfile.lock": ("rubygems.org",),
}
JSON_KINDS = ("package-lock.json", "npm-shrinkwrap.json", "pipfile.lock", "flake.lock", "bun.lock")
NPM_KINDS = ("package-lock.json", "npm-shrinkwrap.json", "bun.lock", "yarn.lock", "pnpm-lock.yaml")
TOML_KINDS, YAML_KINDS = ("cargo.lock", "uv.lock", "poetry.lock", "pdm.lock"), ("pnpm-lock.yaml", "yarn.lock")
PARSED_KINDS = (*JSON_KINDS, *TOML_KINDS, *YAML_KINDS)
# Fixed patterns: hosted-git words, a protocol before a colon, a version, and what no lockfile's string holds.
GIT_WORD = r"(?:[A-Za-z0-9.-]+\+)?(?:git|github|gitlab|bitbucket|gist)(?:\+[A-Za-z0-9.-]+)?"
GIT_SPEC = rf"(?i)(?<![A-Za-z0-9+./-])({GIT_WORD}):(?!\s)"
SPEC_PREFIX, VERSION = r"^([A-Za-z][A-Za-z0-9+.-]*):(?!\s)", r"^[0-9][0-9A-Za-z.+-]*$"
URL_WORD = r"(?i)^(?:\w+\+)?(?:https?|ftp|wss?|git|ssh)$"
CONTROL = r"[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]"
LOCAL_PROTOCOLS, SAFE_PROTOCOLS = ("file", "link", "portal"), ("npm", "workspace", "catalog", "patch", "file", "link", "portal")
FLAKE_TYPES = ("github", "git", "tarball", "file", "path", "indirect")
METADATA = ("funding", "deprecated", "license")
MULTI_LINE, NOT_FETCHABLE = "multi-line or control-character string", "fetch slot that is not an https URL or a local path"
# Possessive: Java recurses on a group that it may give back, once for each character.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
SLOT = "struct<what:string,value:string,n:bigint>"
# Fixed pattern: the note by which classic yarn's own format, which is no YAML, is known.
YARN_V1 = r"(?i)^(?:#(?!\s+yarn\s+lockfile\s+v1\r?\n)[^\n]*+\n)*+#\s+yarn\s+lockfile\s+v1\r?\n"


def hosts_of(kind: Column, extra: tuple[str, ...] = ()) -> Column:
    """The hosts a lockfile of this kind may fetch from, the extra ones too; null for no lockfile."""
    table = F.create_map(*[x for k, v in HOSTS.items() for x in (F.lit(k), F.array(*[F.lit(h) for h in v]))])
    more = F.array(*[F.lit(h) for h in extra]).cast("array<string>")
    return F.when(kind.isNotNull(), F.array_union(F.try_element_at(table, kind), more))


def renamed_from_other_kind(path: Column, old_path: Column) -> Column:
    """Whether a file comes from one that is no lockfile of its kind, so that nothing in it counts as known."""
    return old_path.isNotNull() & ~lockfile_kind(old_path).eqNullSafe(lockfile_kind(path))


def lock_sides(files: DataFrame, heads: DataFrame, bases: DataFrame) -> DataFrame:
    """path, kind, head, base of changed lockfiles that are read whole. files(path, old_path, status), heads and bases(path, content).

    The base is the old path's, unless the file was renamed from another
    kind; content that is not there, or was over the cap, is null.
    """
    kind = lockfile_kind(F.col("path"))
    other = renamed_from_other_kind(F.col("path"), F.col("old_path"))
    wanted = files.where("status <> 'deleted'").select("path", kind.alias("kind"), F.when(~other, F.coalesce("old_path", "path")).alias("_base_path"), other.alias("_other"))
    wanted = wanted.where(F.col("kind").isin(*PARSED_KINDS) | (F.col("kind") == "requirements") | (F.col("kind").isNotNull() & F.col("_other")))
    # Contents that are made in the plan are larger than Spark thinks: none is broadcast. Few files have a base, so its text goes through both joins.
    based = wanted.join(bases.select(F.col("path").alias("_base_path"), F.col("content").alias("base")).hint("merge"), "_base_path", "left").select("path", "kind", "base")
    return by_key(based, "path").join(by_key(heads.select("path", F.col("content").alias("head")), "path").hint("merge"), "path", "left").select("path", "kind", "head", "base")


def without_trailing_commas(kind: Column, doc: Column) -> Column:
    """bun's JSON as JSON: a comma before a closing bracket goes, one within a string stays."""
    return F.when(kind == "bun.lock", F.regexp_replace(doc, r'("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+")|,(?=[ \t\r\n]*[\]}])', "$1")).otherwise(doc)


def lock_nodes(sides: DataFrame) -> DataFrame:
    """path, kind, side, place, type, value of the nodes of all parsed lockfiles. sides: as of `lock_sides`.

    side: head, base, or `both` for a text that is both, which is read once. A
    head that is not there has a row `unparsed` of side `none`, one in classic
    yarn's own format one of side `classic`, so that sides are made once.
    """
    text = lambda side, raw: F.struct(F.lit(side).alias("side"), raw.alias("raw"))
    head, base, no_text = F.col("head"), F.col("base"), F.lit("\x00").cast("binary")
    marks = F.array_compact(F.array(F.when(head.isNull(), text("none", no_text)), F.when((F.col("kind") == "yarn.lock") & head.cast("string").rlike(YARN_V1), text("classic", no_text))))
    stack = F.explode(F.concat(F.when(head == base, F.array(text("both", head))).otherwise(F.array(text("head", head), text("base", base))), marks))
    docs = sides.select("path", "kind", stack.alias("s")).where("s.raw is not null").select("path", "kind", "s.side", F.regexp_replace(F.col("s.raw").cast("string"), "^\\x{FEFF}", "").alias("doc"))
    docs = docs.withColumn("doc", F.when(F.is_valid_utf8("doc"), without_trailing_commas(F.col("kind"), F.col("doc"))).otherwise("\x00"))
    # Of containers only those in slots are compared as they are written.
    found = json_nodes(docs.where(F.col("kind").isin(*JSON_KINDS)), told=lambda place: slot_of(F.col("kind"), place).isNotNull())
    return found.unionByName(toml_nodes(docs.where(F.col("kind").isin(*TOML_KINDS)))).unionByName(yaml_nodes(docs.where(F.col("kind").isin(*YAML_KINDS))))


def first_other(place: Column) -> Column:
    """Of npm's older nested dependencies: the first even step (from 0) that is not `dependencies`, where a package's own fields are."""
    steps = F.sequence(F.lit(0), F.greatest(F.size(place) - 1, F.lit(0)), F.lit(2))
    return F.try_element_at(F.filter(steps, lambda i: ~F.get(place, i).eqNullSafe(F.lit(".dependencies"))), F.lit(1))


def entry_steps(kind: Column, place: Column) -> Column:
    """How many steps lead to the package entry that a place is in, by where each format keeps its packages; null for none."""
    top = F.get(place, F.lit(0))
    nested = first_other(place)
    return (
        F.when(kind.isin("package-lock.json", "npm-shrinkwrap.json"), F.when(top == ".packages", 2).when(nested > 0, nested))
        .when(kind == "pnpm-lock.yaml", F.when(top.isin(".packages", ".snapshots"), 2))
        .when(kind == "bun.lock", F.when((top == ".packages") & F.get(place, F.lit(2)).startswith("["), 3))
        .when(kind == "yarn.lock", F.when(top != ".__metadata", 1))
    )


def metadata_above(kind: Column, place: Column) -> Column:
    """The place of the package entry's metadata that a place is, or is in; null for most."""
    steps = entry_steps(kind, place)
    return F.when(F.get(place, steps).isin(*[f".{x}" for x in METADATA]), F.array_join(F.slice(place, F.lit(1), steps + 1), "\x00"))


def telling(nodes: DataFrame) -> DataFrame:
    """The nodes that findings can come from, as each of their patterns holds a colon (npm's perhaps as %3A) or a control character, and slots, metadata and what does not parse; of a text that is head and base alike, what does not parse."""
    name = F.when(F.col("type") != "unparsed", F.try_element_at("place", F.lit(-1)))
    asked = lambda t: F.contains(t, F.lit(":")) | F.contains(t, F.lit("%")) | t.rlike(CONTROL)
    found = (F.col("type") == "string") & asked(F.col("value")) | name.startswith(".") & asked(name) | slot_of(F.col("kind"), F.col("place")).isNotNull() | metadata_above(F.col("kind"), F.col("place")).isNotNull()
    return nodes.where((F.col("type") == "unparsed") | (F.col("side") != "both") & found)


def lock_strings(nodes: DataFrame) -> DataFrame:
    """path, kind, side, value, n, n_meta of every string, keys included: how often it may be fetched from, and how often it is metadata. nodes: as of `lock_nodes`.

    Metadata is what stands under funding, deprecated or license in a package
    entry, if all of it is a string, a mapping of type and url, or a list of
    such: nothing fetches from it.
    """
    place, steps = F.col("place"), entry_steps(F.col("kind"), F.col("place"))
    rest = F.slice(place, steps + 2, F.size(place))
    known = F.col("type").isin("string", "object", "array")
    shaped = (
        F.when(F.size(rest) == 0, known).when(F.size(rest) == 1, F.when(rest[0].startswith("["), F.col("type").isin("string", "object")).otherwise(rest[0].isin(".type", ".url") & (F.col("type") == "string")))
        .otherwise((F.size(rest) == 2) & rest[0].startswith("[") & F.get(rest, F.lit(1)).isin(".type", ".url") & (F.col("type") == "string"))
    )
    own = nodes.withColumns({"under": metadata_above(F.col("kind"), place), "shaped": F.coalesce(shaped, F.lit(False)), "below": F.size(place) > steps + 1})
    whole = F.min("shaped").over(Window.partitionBy("path", "kind", "side", "under"))
    judged = own.withColumn("meta", F.col("under").isNotNull() & whole)
    key = F.when(F.element_at("place", -1).startswith("."), F.struct(F.substring(F.element_at("place", -1), F.lit(2), F.length(F.element_at("place", -1))).alias("value"), (F.col("meta") & F.coalesce("below", F.lit(False)) & (F.size(place) > steps + 1)).alias("meta")))
    text = F.when(F.col("type") == "string", F.struct("value", "meta"))
    strings = judged.where("size(place) > 0 or type = 'string'").select("path", "kind", "side", F.explode(F.array_compact(F.array(F.when(F.size(place) > 0, key), text))).alias("s"))
    return strings.groupBy("path", "kind", "side", "s.value").agg(F.count_if(~F.col("s.meta")).alias("n"), F.count_if(F.col("s.meta")).alias("n_meta"))


def slot_of(kind: Column, place: Column) -> Column:
    """struct(slot, of): which slot a place is a field of, and where that is; null for most places, and for all but one or two within each other."""
    top, last, size = F.get(place, F.lit(0)), F.try_element_at(place, F.lit(-1)), F.size(place)
    npm = kind.isin("package-lock.json", "npm-shrinkwrap.json")
    # The fields of an entry, or of what an entry holds, by their names.
    return (
        F.when(npm & (top == ".packages") & (size == 3) & last.isin(".resolved", ".link"), F.struct(F.lit("npm").alias("slot"), F.slice(place, 1, 2).alias("of")))
        .when(npm & (size > 2) & (first_other(place) == size - 1) & (last == ".resolved"), F.struct(F.lit("npm").alias("slot"), F.slice(place, F.lit(1), size - 1).alias("of")))
        .when((kind == "pnpm-lock.yaml") & (top == ".packages") & (F.get(place, F.lit(2)) == ".resolution") & size.isin(3, 4), F.struct(F.lit("resolution").alias("slot"), F.slice(place, 1, 3).alias("of")))
        .when((kind == "bun.lock") & (top == ".packages") & (size == 3) & last.isin("[0]", "[1]"), F.struct(F.lit("spec").alias("slot"), F.slice(place, 1, 2).alias("of")))
        .when((kind == "yarn.lock") & (size == 2) & (last == ".resolution"), F.struct(F.lit("spec").alias("slot"), place.alias("of")))
        .when((kind == "yarn.lock") & (size == 2) & (last == ".resolved"), F.struct(F.lit("npm").alias("slot"), place.alias("of")))
        .when((kind == "flake.lock") & (top == ".nodes") & F.get(place, F.lit(2)).isin(".locked", ".original") & size.isin(3, 4), F.struct(F.lit("flake").alias("slot"), F.slice(place, 1, 3).alias("of")))
    )


def lock_slots(nodes: DataFrame) -> DataFrame:
    """path, kind, side, slot, value, more of the places that packages are fetched from. nodes: as of `lock_nodes`.

    slot: `resolved` or `linked` (npm, yarn), `spec` (yarn, bun) with bun's
    tarball in `more`, `resolution` (pnpm) with its fields in `more`, `flake`,
    `odd` for a slot that holds no string. value: the whole of it.
    """
    place, of = F.col("place"), slot_of(F.col("kind"), F.col("place"))
    last, size = F.element_at(place, -1), F.size(place)
    fields = nodes.withColumn("at", of).where("at is not null").groupBy("path", "kind", "side", "at").agg(F.collect_list(F.struct(last.alias("name"), "type", "value", size.alias("steps"))).alias("fields"))

    def field(name: str) -> Column:
        return F.try_element_at(F.filter("fields", lambda f: f["name"] == name), F.lit(1))

    own = F.try_element_at(F.filter("fields", lambda f: f["steps"] == F.size("at.of")), F.lit(1))
    rows = fields.select("path", "kind", "side", F.col("at.slot").alias("of"), "fields", own.alias("own"), field(".resolved").alias("resolved"), field(".link").alias("link"), F.coalesce(field(".resolution"), field("[0]")).alias("spec"), field("[1]").alias("tarball"))
    more = F.map_from_entries(F.transform(F.filter("fields", lambda f: f["name"].isin(".repo", ".type", ".tarball", ".directory", ".host")), lambda f: F.struct(F.substring(f["name"], 2, 20), F.struct(f["type"].alias("type"), f["value"].alias("value")))))
    plain = lambda f: F.when(f["type"] == "string", f["value"])
    slot = (
        F.when((F.col("of") == "npm") & F.col("resolved").isNotNull(), F.struct(F.when(F.col("resolved.type") != "string", "odd").when((F.col("link.type") == "other") & (F.col("link.value") == "true"), "linked").otherwise("resolved").alias("slot"), F.coalesce("resolved.value", F.lit("")).alias("value")))
        .when((F.col("of") == "spec") & F.col("spec").isNotNull(), F.struct(F.when(F.col("spec.type") != "string", "odd").otherwise("spec").alias("slot"), F.coalesce("spec.value", F.lit("")).alias("value")))
        .when(F.col("of") == "resolution", F.struct(F.when(F.col("own").isNull() | (F.col("own.type") != "object"), "odd").otherwise("resolution").alias("slot"), F.to_json(F.array_sort("fields")).alias("value")))
        .when((F.col("of") == "flake") & (F.col("own.type") == "object"), F.struct(F.lit("flake").alias("slot"), F.to_json(F.array_sort("fields")).alias("value")))
    )
    return rows.select("path", "kind", "side", slot.alias("s"), F.when(F.col("of").isin("resolution", "flake"), more).alias("more"), F.when(F.col("kind") == "bun.lock", plain(F.col("tarball"))).alias("tarball")).where("s is not null").select("path", "kind", "side", "s.*", "more", "tarball")


def is_local(ref: Column) -> Column:
    """A relative path, before # or ::, without a colon."""
    path = F.regexp_extract(ref, r"^(.*?)(?:#|::|$)", 1)
    return (path != "") & ~path.rlike(r"^[/\\~]") & ~F.contains(path, F.lit(":"))


def spec_findings(value: Column) -> Column:
    """Package specs in a string that fetch from elsewhere than the registry: hosted-git words, unknown protocols, paths that lead away."""
    git = F.transform(F.regexp_extract_all(value, F.lit(GIT_SPEC), F.lit(1)), lambda w: F.concat(F.lit("hosted-git spec "), F.substring(F.lower(w), 1, 32), F.lit(":")))
    word = F.lower(F.regexp_extract(value, SPEC_PREFIX, 1))
    known = (word == "") | word.rlike(f"^{GIT_WORD}$") | word.rlike(URL_WORD)
    rest = F.substring(value, F.length(word) + 2, F.length(value))
    said = F.when(known, None).when(~word.isin(*SAFE_PROTOCOLS), F.concat(F.lit("package spec protocol "), F.substring(word, 1, 32), F.lit(":"))).when(word.isin(*LOCAL_PROTOCOLS) & ~is_local(rest), F.concat(word, F.lit(": reference that is not a relative path")))
    # Each of the patterns holds a colon; a null stays one.
    return F.when(~F.contains(value, F.lit(":")), F.array().cast("array<string>")).otherwise(F.concat(git, F.array_compact(F.array(said))))


def is_https(value: Column) -> Column:
    return F.lower(F.substring(value, 1, 6)) == "https:"


def bad_resolved(value: Column, linked: Column) -> Column:
    """Whether it is neither an https URL, nor a `file:` with a relative path, nor (where npm marks a link) a relative path."""
    file = (F.lower(F.substring(value, 1, 5)) == "file:") & is_local(F.substring(value, F.lit(6), F.length(value)))
    return ~(is_https(value) | file | (linked & is_local(value)))


def bad_spec(value: Column) -> Column:
    """Whether the spec of `name@spec` is neither a version, nor an https URL, nor of a safe protocol (a local one with a relative path)."""
    at = F.locate("@", value, 2)
    spec = F.when(at > 1, F.substring(value, at + 1, F.length(value)))
    word = F.lower(F.regexp_extract(spec, SPEC_PREFIX, 1))
    safe = word.isin(*SAFE_PROTOCOLS) & (~word.isin(*LOCAL_PROTOCOLS) | is_local(F.substring(spec, F.length(word) + 2, F.length(spec))))
    return ~F.coalesce(spec.rlike(VERSION) | is_https(spec) | safe, F.lit(False))


def bad_slot() -> Column:
    """Whether a row of `lock_slots` but a flake's cannot be fetched from where it should be."""
    slot, value, more = F.col("slot"), F.col("value"), F.col("more")
    odd_type = ~F.coalesce(more["type"]["type"] == "other", F.lit(True)) & ~more["type"]["value"].eqNullSafe(F.lit("directory"))
    tarball = more["tarball"].isNotNull() & ((more["tarball"]["type"] != "string") | bad_resolved(more["tarball"]["value"], F.lit(False)))
    folder = more["directory"].isNotNull() & ((more["directory"]["type"] != "string") | ~is_local(more["directory"]["value"]))
    return F.coalesce(
        F.when(slot == "odd", F.lit(True)).when(slot.isin("resolved", "linked"), bad_resolved(value, slot == "linked"))
        .when(slot == "spec", bad_spec(value) | F.coalesce((F.col("tarball") != "") & ~is_https(F.col("tarball")), F.lit(False)))
        .when(slot == "resolution", more["repo"].isNotNull() | odd_type | tarball | folder), F.lit(False),
    )


def percent_decoded(value: Column) -> Column:
    """A string with its %XX as bytes of UTF-8; plus signs stay, and a text that comes out as no UTF-8 has U+FFFD."""
    parts = F.transform(F.regexp_extract_all(value, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0)), lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(x, 2, 2)).otherwise(F.hex(x.cast("binary"))))
    return F.when(F.contains(value, F.lit("%")), F.make_valid_utf8(F.unhex(F.array_join(parts, "")).cast("string"))).otherwise(value)


def lock_findings(nodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """path, side, what, value, n: bad values of lockfiles, counted by the whole value. nodes: as of `lock_nodes`."""
    npm = F.col("kind").isin(*NPM_KINDS)
    strings = lock_strings(nodes).withColumns({"npm": npm, "allowed": hosts_of(F.col("kind"), extra)})
    forms = F.when(F.col("npm"), F.array_distinct(F.array(F.col("value"), percent_decoded(F.col("value"))))).otherwise(F.array("value"))
    none, empty = F.array().cast("array<string>"), F.array().cast(f"array<{SLOT}>")
    checked = F.flatten(F.transform(forms, lambda t: F.transform(F.concat(bad_urls(t, F.col("allowed")), F.when(F.col("npm"), spec_findings(t)).otherwise(none)), lambda w: F.struct(w.alias("what"), t.alias("value"), F.col("n").alias("n")))))
    control = F.when(F.col("value").rlike(CONTROL), F.array(F.struct(F.lit(MULTI_LINE).alias("what"), F.col("value"), (F.col("n") + F.col("n_meta")).alias("n")))).otherwise(empty)
    of_strings = strings.select("path", "side", F.explode(F.concat(control, F.when(F.col("n") > 0, checked).otherwise(empty))).alias("f"))
    one, more = F.lit(1).cast("long"), F.col("more")
    text = F.when(more["type"]["type"] == "string", more["type"]["value"])
    host = F.when(more["host"].isNotNull() & ~more["host"]["value"].eqNullSafe(F.lit("null")), more["host"]["value"])
    flake = F.array_compact(F.array(
        F.when(~F.coalesce(text.isin(*FLAKE_TYPES), F.lit(False)), F.struct(F.concat(F.lit("flake input type "), F.coalesce(more["type"]["value"], F.lit("None"))).alias("what"), F.col("value"), one.alias("n"))),
        F.when(host.isNotNull() & ~F.array_contains(hosts_of(F.col("kind"), extra), F.lower(host)), F.struct(F.concat(F.lit("flake host "), host).alias("what"), F.col("value"), one.alias("n"))),
    ))
    bad = F.when(F.col("slot") == "flake", flake).when(bad_slot(), F.array(F.struct(F.lit(NOT_FETCHABLE).alias("what"), F.concat_ws("\n", "value", "tarball").alias("value"), one.alias("n")))).otherwise(empty)
    of_slots = lock_slots(nodes).select("path", "side", F.explode(bad).alias("f"))
    return of_strings.unionByName(of_slots).groupBy("path", "side", "f.what", "f.value").agg(F.sum("f.n").alias("n"))


def reported(path_findings: DataFrame) -> DataFrame:
    """path, detail: the first four of what is wrong, once each, by name. path_findings(path, what)."""
    return path_findings.groupBy("path").agg(F.concat(F.lit("not allowlisted: "), F.array_join(F.slice(F.array_sort(F.collect_set("what")), 1, 4), ", ")).alias("detail"))


def parsed_hits(sides: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """path, detail of parsed lockfiles with more of a bad value in the head than in the base, that do not parse, or were too large to read.

    A base that does not parse has no findings, and a head that equals its base
    none that are new. Classic yarn's own format is checked by its lines and may
    fail to parse.
    """
    own = sides.where(F.col("kind").isin(*PARSED_KINDS))
    # Read three times: for strings, slots and what does not parse. All that follows is by path, and more.
    nodes = by_key(written(telling(lock_nodes(own)), "lock-nodes"), "path")
    unparsed = nodes.where("type = 'unparsed'").select("path", "side").distinct()
    found = lock_findings(nodes, extra).join(unparsed, ["path", "side"], "left_anti")
    counts = found.groupBy("path", "what", "value").agg(F.sum(F.when(F.col("side") == "head", F.col("n")).otherwise(-F.col("n"))).alias("more"))
    said = unparsed.groupBy("path").agg(F.collect_set("side").alias("of"))
    unread = said.where(F.arrays_overlap("of", F.array(F.lit("head"), F.lit("both"))) & ~F.array_contains("of", "classic")).select("path", F.lit("lockfile does not parse").alias("detail"))
    large = said.where(F.array_contains("of", "none")).select("path", F.lit("lockfile too large to check").alias("detail"))
    return reported(counts.where("more > 0")).unionByName(unread).unionByName(large)


# Where Python ends a line, and the escapes of one character.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
SIMPLE = {"/": "/", "\\": "\\", '"': '"', "'": "'", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def physical_lines(texts: DataFrame) -> DataFrame:
    """path, line_no, part, line as pip splits a file: at more ends than git has, whose numbers the lines keep. texts(path, text)."""
    found = F.regexp_extract_all("text", F.lit(rf"(?s)(.*?)({LINE_ENDS}|\z)"), F.lit(1))
    ends = F.regexp_extract_all("text", F.lit(rf"(?s)(.*?)({LINE_ENDS}|\z)"), F.lit(2))
    pieces = texts.select("path", F.posexplode(F.arrays_zip(found.alias("line"), ends.alias("end"))).alias("part", "x")).where("x.line <> '' or x.end <> ''")
    order = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("path", (F.coalesce(F.sum(F.contains("x.end", F.lit("\n")).cast("int")).over(order), F.lit(0)) + 1).cast("long").alias("line_no"), "part", F.col("x.line").alias("line"))


def decoded_escapes(text: Column) -> Column:
    """struct(text, unknown): backslash escapes of double-quoted strings decoded, and whether one was none."""
    simple = F.create_map(*[F.lit(x) for pair in SIMPLE.items() for x in pair])

    def one(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))$", 0)
        value = F.lpad(F.substring(digits, F.lit(3), F.length(digits)), 8, "0")
        point = F.when((digits != "") & (F.lower(value) <= "0010ffff"), F.decode(F.unhex(value), "UTF-32"))
        return F.when(~token.startswith("\\") | (F.length(token) == 1), F.struct(token.alias("t"), F.lit(False).alias("u"))).otherwise(
            F.coalesce(F.when(point.isNotNull(), F.struct(point.alias("t"), F.lit(False).alias("u"))), F.when((F.length(token) == 2) & F.map_contains_key(simple, F.substring(token, 2, 1)), F.struct(F.try_element_at(simple, F.substring(token, 2, 1)).alias("t"), F.lit(False).alias("u"))), F.struct(token.alias("t"), F.lit(True).alias("u")))
        )

    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|.)|[^\\]+|\\"), F.lit(0)), one)
    plain = F.struct(text.alias("text"), F.lit(False).alias("unknown"))
    return F.when(F.contains(text, F.lit("\\")), F.struct(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.exists(parts, lambda p: p["u"]).alias("unknown"))).otherwise(plain)


def pip_options(line: Column) -> Column:
    """A line's options as pip reads them: from the first word with a dash, quotes resolved, attached values parted; null where quotes do not close."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(line, r"(^|\s+)#.*$", "")), r"\\$", "")
    options = F.regexp_extract(bare, r"(?:^| )(-.*)$", 1)
    words = F.regexp_extract_all(options, F.lit(rf"""(?:[^\s"'\\]++|\\.|{STRING}|'[^']*+')++"""), F.lit(0))
    whole = options.rlike(rf"""^(?:[^"'\\]++|\\.|{STRING}|'[^']*+')*+$""")
    plain = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"'([^']*)'", "$1"), r"""(?<!\\)\"""", ""), r"\\(.)", "$1"))
    return F.when(whole, F.array_join(F.transform(plain, lambda w: F.regexp_replace(w, r"^(-[icref])(?=.)", "$1 ")), " "))


def continues(line: Column, pip: Column) -> Column:
    """Whether a line alone may glue the next one onto a URL: an odd run of last backslashes; for pip any run that no blank precedes."""
    body = F.regexp_replace(line, r"\s+$", "")
    run = F.regexp_extract(body, r"(\\*)$", 1)
    before = F.substring(body, F.length(body) - F.length(run), F.lit(1))
    return F.when(pip, (F.length(run) > 0) & ~((F.length(body) > F.length(run)) & before.rlike(r"^\s$"))).otherwise(F.length(run) % 2 == 1)


def line_hits(lines: DataFrame, resolved: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """path, line_no, detail of lines that fetch from elsewhere. lines(path, line_no, line); `resolved` lines are whole, so a last backslash is content."""
    kind = lockfile_kind(F.col("path"))
    read = lines.withColumns({"kind": kind, "own": decoded_escapes(F.col("line"))}).withColumn("allowed", hosts_of(F.col("kind"), extra)).where("kind is not null")
    pip = F.col("kind") == "requirements"
    options = F.when(pip, pip_options(F.col("line")))
    none = F.array().cast("array<string>")
    yarn = F.concat(F.filter(spec_findings(F.col("own.text")), lambda w: w.startswith("hosted-git")), F.when(bad_resolved(F.regexp_extract("own.text", r'^\s+resolved\s+"?([^"]*)"?\s*$', 1), F.lit(False)) & F.col("own.text").rlike(r"^\s+resolved\s"), F.array(F.lit(NOT_FETCHABLE))).otherwise(none))
    bad = F.concat(
        none if resolved else F.when(continues(F.col("line"), pip), F.array(F.lit("line continuation"))).otherwise(none),
        F.when(F.col("own.unknown") & F.col("own.text").rlike(r"[A-Za-z][A-Za-z0-9+.-]*(?::|\\)"), F.array(F.lit("undecodable escape near a URL"))).otherwise(none),
        bad_urls(F.col("own.text"), F.col("allowed")),
        F.when(pip & options.isNull(), F.array(F.lit("options pip cannot split"))).when(pip, bad_urls(options, F.col("allowed"))).otherwise(none),
        F.when(F.col("kind") == "yarn.lock", yarn).otherwise(none),
    )
    found = read.select("path", "line_no", F.array_distinct(bad).alias("bad")).where(F.size("bad") > 0)
    return found.select("path", "line_no", F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": not allowlisted: "), F.array_join(F.slice("bad", 1, 4), ", ")).alias("detail"))


def requirements_hits(sides: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """path, line_no, detail of pip's logical lines that the base does not have as often."""
    own = sides.where("kind = 'requirements'")

    def logical(side: str) -> DataFrame:
        texts = own.where(F.col(side).isNotNull()).select("path", F.make_valid_utf8(F.col(side).cast("string")).alias("text"))
        # Parts of one numbered line keep their order by a fraction of it.
        lines = physical_lines(texts).select("path", (F.col("line_no") * F.lit(1 << 32) + F.col("part")).alias("line_no"), "line")
        return logical_lines(lines)

    new = new_lines(logical("head"), logical("base")).withColumn("line_no", F.shiftright("line_no", 32))
    large = own.where("head is null").select("path", F.lit(None).cast("long").alias("line_no"), F.lit("lockfile too large to check").alias("detail"))
    return line_hits(new, True, extra).unionByName(large)


def lockfile_hits(files: DataFrame, heads: DataFrame, bases: DataFrame, added: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """path, detail of all lockfile rules: JSON, TOML and YAML ones whole, pip's by logical lines, others and classic yarn's by their added lines.

    files(path, old_path, status), heads and bases(path, content), added(path,
    line_no, text). A file of the line-checked kinds that was renamed from
    another kind is checked whole.
    """
    sides = lock_sides(files, heads, bases)
    plain = sides.where(~F.col("kind").isin(*PARSED_KINDS, "requirements"))
    whole = plain.where("head is not null").select("path", F.posexplode(F.split(F.make_valid_utf8(F.col("head").cast("string")), "\n", -1)).alias("at", "line")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")
    large = plain.where("head is null").select("path", F.lit("lockfile too large to check").alias("detail"))
    kind, other = lockfile_kind(F.col("path")), renamed_from_other_kind(F.col("path"), F.col("old_path"))
    classic = sides.where((F.col("kind") == "yarn.lock") & F.col("head").cast("string").rlike(YARN_V1)).select("path")
    read_whole = files.where("status <> 'deleted'").where(kind.isin(*PARSED_KINDS)).select("path").join(classic, "path", "left_anti")
    by_line = files.where("status <> 'deleted'").where(kind.isNotNull() & (kind != "requirements") & ~other).select("path").join(read_whole, "path", "left_anti")
    lines = added.join(by_line, "path", "left_semi").select("path", F.col("line_no").cast("long").alias("line_no"), F.col("text").alias("line"))
    found = line_hits(lines.unionByName(whole), False, extra).unionByName(requirements_hits(sides, extra)).select("path", "detail")
    return found.unionByName(parsed_hits(sides, extra)).unionByName(large)
