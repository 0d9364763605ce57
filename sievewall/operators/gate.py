"""Review of code changes by tables: paths, contents, added lines, findings, reviews."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewall.functions.unicode import code_point_name, hidden_points

# First bytes of known formats, in the order in which they claim a file.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"\x00\x00\x01\x00", "ico"), (b"wOF2", "woff2"),
    (b"wOFF", "woff"), (b"OTTO", "otf"), (b"\x00\x01\x00\x00", "ttf"), (b"%PDF-", "pdf"), (b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\x1f\x8b", "gzip"),
    (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"\x7fELF", "elf"), (b"MZ", "pe"), (b"\x00asm", "wasm"),
    (b"#!", "script"), (b"\xcf\xfa\xed\xfe", "macho"), (b"\xce\xfa\xed\xfe", "macho"), (b"\xfe\xed\xfa\xcf", "macho"), (b"\xfe\xed\xfa\xce", "macho"), (b"\xca\xfe\xba\xbe", "macho"),
)
# The format that a file name's ending promises, and other endings of known binary formats.
ENDINGS = {
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "webp": "webp", "ico": "ico", "woff2": "woff2", "woff": "woff", "otf": "otf", "ttf": "ttf",
    "pdf": "pdf", "zip": "zip", "jar": "zip", "whl": "zip", "docx": "zip", "xlsx": "zip", "pptx": "zip", "gz": "gzip", "tgz": "gzip", "bz2": "bzip2",
    "xz": "xz", "zst": "zstd", "7z": "7z", "wasm": "wasm",
}
OTHER_BINARY = (
    "bmp tif tiff heic avif icns psd mp3 mp4 m4a wav ogg oga opus flac webm mov avi mkv eot tar rar deb rpm dmg iso so dll dylib exe class pyc pyd o a lib "
    "db sqlite sqlite3 mo parquet npy npz pkl pt onnx xls doc ppt odt ods odp key p12 pfx jks keystore der bin dat"
).split()
EXECUTABLE = ("elf", "pe", "macho", "wasm", "script")
# Files and folders that instruct coding agents, and paths that no exception covers.
AGENT_FILES = ("claude.md", "claude.local.md", "agents.md", "agents.override.md", ".mcp.json")
AGENT_FOLDERS = (".claude", ".codex")
NEVER_EXEMPT = (".github/workflows/", ".github/actions/")
# Findings that block, and the order of severities.
BLOCKING = (("malicious", "medium"), ("malicious", "high"), ("obscure", "medium"), ("obscure", "high"), ("security", "high"))
SEVERITIES = ("high", "medium", "low")


def magic_type(content: Column) -> Column:
    """The format that the first bytes name, or null."""
    head = F.hex(F.substring(content, 1, 12))
    found = F.lit(None).cast("string")
    for prefix, kind in reversed(MAGIC):
        found = F.when(head.startswith(prefix.hex().upper()), kind).otherwise(found)
    return F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").otherwise(found)


def extension(path: Column) -> Column:
    """The part of the name behind its last dot, lower-cased; none for a name that begins or ends with its only dot."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]+)$", 1))


def binary_hits(files: DataFrame, contents: DataFrame) -> DataFrame:
    """path, rule, detail, overridable of binary files that stay. files(path, status, binary), contents(path, content)."""
    joined = files.where("binary and status <> 'deleted'").join(contents, "path", "left")
    ending = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    kinds = joined.select("path", "content", extension(F.col("path")).alias("ext"), magic_type(F.col("content")).alias("kind")).withColumn("promised", F.try_element_at(ending, F.col("ext")))
    unknown = ~F.col("ext").isin(*ENDINGS, *OTHER_BINARY) | F.coalesce(F.col("kind") == "script", F.lit(False))
    mismatch = F.coalesce(F.col("kind") != F.col("promised"), F.lit(False))
    detail = (
        F.when(F.col("content").isNull(), "content not fetched")
        .when(F.col("kind").isNull(), "unrecognised content type")
        .when(mismatch, F.format_string("mismatch: content is %s, extension says %s", "kind", "promised"))
        .otherwise(F.concat(F.lit("content is "), F.col("kind")))
    )
    detail = F.concat(detail, F.when(F.col("kind").isin(*EXECUTABLE), " (executable)").otherwise(""))
    return kinds.select(
        "path",
        F.when(unknown | mismatch, "text-binary").otherwise("binary").alias("rule"),
        F.when(unknown, "not a known binary type").otherwise(detail).alias("detail"),
        (~unknown & ~mismatch).alias("overridable"),
    )


CONTROLS, PATH_CONTROLS = r"[\x00-\x08\x0a\x0b\x0d-\x1f\x7f-\x9f]", r"[\x00-\x1f\x7f-\x9f]"


def odd_characters(text: Column, controls: str, own: Column | None = None) -> Column:
    """Code points of characters that are hidden in source code, then of control characters (in `own`, if it is given)."""
    return F.concat(hidden_points(text, "code"), F.transform(F.regexp_extract_all(text if own is None else own, F.lit(controls), F.lit(0)), lambda c: F.ascii(c)))


def named_characters(points: Column, most: int = 8) -> Column:
    """The first distinct code points in order, by name."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.array_distinct(points)), 1, most), code_point_name), ", ")


def hidden_hits(files: DataFrame, added: DataFrame) -> DataFrame:
    """path, line_no, detail of paths (line_no is null) and added lines with hidden or control characters.

    files(path, status), added(path, line_no, text). A path that a change
    deletes may keep them. In a line a tab, a form feed and a last carriage
    return are in order; in a path no control character is.
    """
    paths = files.where("status <> 'deleted'").select("path", F.lit(None).cast("long").alias("line_no"), odd_characters(F.col("path"), PATH_CONTROLS).alias("points"), F.lit("in the file path: ").alias("where"))
    line = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "))
    lines = added.select("path", F.col("line_no").cast("long").alias("line_no"), odd_characters(F.col("text"), CONTROLS, F.regexp_replace("text", "\r\\z", "")).alias("points"), line.alias("where"))
    return paths.unionByName(lines).where(F.size("points") > 0).select("path", "line_no", F.concat("where", named_characters(F.col("points"))).alias("detail"))


SUBMODULE = "submodule pointer: its content is not reviewed; check the target repo/commit before dismissing"


def submodule_hits(files: DataFrame) -> DataFrame:
    """path, detail of submodule pointers that stay. files(path, status, gitlink)."""
    return files.where("gitlink and status <> 'deleted'").select("path", F.lit(SUBMODULE).alias("detail"))


def found_binary(status: Column, binary: Column, body: Column, gitlink: Column, content: Column, peek: int = 8000) -> Column:
    """Whether a file is binary: as its diff says, or, of a rename without a body, if its content has a zero byte early on."""
    zero = F.contains(F.substring(content, 1, peek), F.lit(bytearray(1)))
    return binary | F.coalesce((status == "renamed") & (F.size(body) == 0) & ~gitlink & zero, F.lit(False))


def glob_pattern(glob: str) -> str:
    """A shell glob, whose star crosses slashes, as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            negated = glob[i + 1] == "!"
            out += ("[^" if negated else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", glob[i + 1 + negated : end]) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def sensitive_paths(files: DataFrame, exceptions: list[str]) -> DataFrame:
    """path, outcome of paths, old ones too, that change CI or instruct agents: hit, or scrutiny where an exception covers it."""
    paths = files.select(F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path")))).alias("path"))
    parts = F.transform(F.split("path", "/"), lambda x: F.lower(x))
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    reason = F.when(F.substring_index("path", "/", 1) == ".github", "github").when(
        F.element_at(parts, -1).isin(*AGENT_FILES) | F.arrays_overlap(folders, F.array(*[F.lit(x) for x in AGENT_FOLDERS])), "agent-instructions"
    )
    never = F.lit(False)
    for prefix in NEVER_EXEMPT:
        never = never | F.col("path").startswith(prefix)
    covered = F.lit(False)
    for glob in exceptions:
        covered = covered | F.col("path").rlike(glob_pattern(glob))
    return paths.withColumn("reason", reason).where("reason is not null").select("path", "reason", F.when(covered & ~never, "scrutiny").otherwise("hit").alias("outcome"))


def new_findings(head: DataFrame, base: DataFrame) -> DataFrame:
    """what, value, n: findings of the head beyond those of the base, copies counted."""
    return head.select("what", "value").exceptAll(base.select("what", "value")).groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


def new_lines(head: DataFrame, base: DataFrame) -> DataFrame:
    """path, line_no, line of the head beyond the base: the nth copy of a line in the base cancels the nth in the head."""
    nth = F.row_number().over(Window.partitionBy("path", "line").orderBy("line_no"))
    keys = ["path", "line", "nth"]
    return head.withColumn("nth", nth).join(base.withColumn("nth", nth).select(*keys), keys, "left_anti").select("path", "line_no", "line")


def logical_lines(lines: DataFrame) -> DataFrame:
    """path, line_no, line as pip reads them: a line that ends in a backslash joins the next; comments end a run.

    lines(path, line_no, line). A comment line never continues and stands
    behind a space; backslashes go from both ends of all lines of a run but
    the last.
    """
    comment = F.col("line").rlike(r"^\s*#")
    joins = F.col("line").endswith("\\") & ~comment
    order = Window.partitionBy("path").orderBy("line_no")
    starts = F.coalesce(~F.lag("joins").over(order), F.lit(True)).cast("int")
    runs = lines.withColumn("joins", joins).withColumn("comment", comment)
    runs = runs.withColumn("start", starts).withColumn("run", F.sum("start").over(order))
    piece = F.when(F.col("joins"), F.regexp_replace("line", r"^\\+|\\+$", "")).when(F.col("comment"), F.concat(F.lit(" "), F.col("line"))).otherwise(F.col("line"))
    return runs.groupBy("path", "run").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))), lambda x: x["piece"]), "").alias("line")
    ).select("path", "line_no", "line")


def decided(hits: DataFrame, passes: DataFrame, findings: DataFrame, threshold: int) -> DataFrame:
    """change_id, block, suspicion, reasons: what the checks and reviewers come to.

    hits(change_id, rule), passes(change_id, name, ord, status, reason,
    suspicion), findings(change_id, ord, category, severity). Reasons are, in
    order: rules by name, incomplete passes, suspicion, blocking findings in
    the order first seen.
    """
    rules = hits.groupBy("change_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("deterministic check: "), F.col("rule")))).alias("rules"))
    incomplete = F.concat(F.lit("reviewer did not complete: "), F.col("name"), F.lit(": "), F.col("reason"))
    by_pass = passes.groupBy("change_id").agg(
        F.max(F.when(F.col("status") == "ok", F.col("suspicion"))).alias("suspicion"),
        F.count_if(F.col("status") == "infra").alias("infra"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "incomplete", F.struct("ord", incomplete.alias("said"))))), lambda x: x["said"]).alias("incomplete"),
    )
    blocking = F.concat_ws(" ", "category", "severity").isin(*[" ".join(x) for x in BLOCKING])
    first = findings.where(blocking).groupBy("change_id", "category", "severity").agg(F.min("ord").alias("ord"))
    found = first.groupBy("change_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.format_string("finding: %s (%s)", "category", "severity").alias("said")))), lambda x: x["said"]).alias("found")
    )
    none = F.array().cast("array<string>")
    joined = by_pass.join(rules, "change_id", "full").join(found, "change_id", "full")
    high = F.when(F.col("suspicion") >= threshold, F.array(F.concat(F.lit("suspicion "), F.col("suspicion").cast("string"), F.lit(f" >= threshold {threshold}")))).otherwise(none)
    reasons = F.concat(F.coalesce("rules", none), F.coalesce("incomplete", none), high, F.coalesce("found", none))
    return joined.select("change_id", ((F.size(reasons) > 0) | (F.coalesce("infra", F.lit(0)) > 0)).alias("block"), "suspicion", F.array_join(reasons, "; ").alias("reasons"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), severity).cast("int")


def top_findings(findings: DataFrame, most: int = 40) -> DataFrame:
    """The most severe findings of each change, in the order they came: change_id, ord, category, severity."""
    order = Window.partitionBy("change_id").orderBy(severity_rank(F.col("severity")), "ord")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("change_id", "place", "ord", "category", "severity")


def newest_marker(reviews: DataFrame) -> DataFrame:
    """change_id, review_id, marker of the newest review that carries a marker."""
    return reviews.where("marker is not null").groupBy("change_id").agg(F.max("review_id").alias("review_id"), F.max_by("marker", "review_id").alias("marker"))


def owner_overrides(timeline: DataFrame, owner: str) -> DataFrame:
    """change_id, overridden: whether the owner dismissed a review posted since the last rewrite of the history.

    timeline(change_id, ord, kind, review_id, actor). A rewrite begins an era;
    only the last one counts, and in it a dismissal only after its review.
    """
    order = Window.partitionBy("change_id").orderBy("ord")
    eras = timeline.withColumn("era", F.sum((F.col("kind") == "rewrite").cast("int")).over(order))
    last = eras.withColumn("last", F.max("era").over(Window.partitionBy("change_id"))).where("era = last")
    by_review = last.groupBy("change_id", "review_id").agg(
        F.min(F.when(F.col("kind") == "reviewed", F.col("ord"))).alias("posted"), F.max(F.when((F.col("kind") == "dismissed") & (F.lower("actor") == owner.lower()), F.col("ord"))).alias("gone")
    )
    return by_review.groupBy("change_id").agg(F.coalesce(F.max(F.col("gone") > F.col("posted")), F.lit(False)).alias("overridden"))


def fitting_contents(files: DataFrame, budget: int) -> DataFrame:
    """change_id, path, taken: files in order as long as they fit what is left; one that does not is passed over.

    files(change_id, ord, path, size). What is left after a file depends on
    every file before it, so a change is one sequence; its rows stream through
    a task in order, whatever their number, and one number is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        change, left = None, budget
        for batch in batches:
            taken = []
            for own, size in zip(batch["change_id"], batch["size"], strict=True):
                if own != change:
                    change, left = own, budget
                fits = bool(size <= left)
                left -= size if fits else 0
                taken.append(fits)
            yield pd.DataFrame({"change_id": batch["change_id"], "path": batch["path"], "taken": taken})

    return files.select("change_id", "ord", "path", "size").repartition("change_id").sortWithinPartitions("change_id", "ord").mapInPandas(run, "change_id long, path string, taken boolean")


# Names that ask for a closer look, and the patterns of install scripts and of pip's files.
INSTALL = r"^(install|setup|bootstrap|preinstall|postinstall)([._-].*)?$"
REQUIREMENTS = r"^(requirements|constraints)[\w.-]*\.(txt|in)$"
MANIFESTS = ("package.json", "pyproject.toml", "setup.cfg", "cargo.toml", "gemfile", "go.mod", "makefile", "dockerfile", ".gitattributes", ".gitmodules", ".npmrc", ".yarnrc", ".yarnrc.yml", "pip.conf")
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "cargo.lock", "uv.lock", "poetry.lock", "pipfile.lock", "pdm.lock", "flake.lock", "gemfile.lock")
VENDORED = ("dist", "vendor", "vendored", "third_party", "node_modules", "generated", "build")
AUTORUN = (".envrc", ".pre-commit-config.yaml", "mise.toml", ".mise.toml", ".tool-versions", ".pnpmfile.cjs", "bunfig.toml", "lefthook.yml")
AUTORUN_PLACES = (".vscode/tasks.json", ".vscode/settings.json", ".vscode/launch.json", ".cargo/config.toml", ".cargo/config")
AUTORUN_FOLDERS = (".devcontainer", ".husky")


def lockfile_kind(path: Column) -> Column:
    """The lockfile's name, `requirements` for pip's files, or null."""
    name = F.lower(F.substring_index(path, "/", -1))
    folder = F.lower(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")))
    pip = name.rlike(REQUIREMENTS) | ((folder == "requirements") & name.rlike(r"\.(txt|in)$"))
    return F.when(name.isin(*LOCKFILES), name).when(pip, "requirements")


def scrutiny(files: DataFrame, long_line: int = 500) -> DataFrame:
    """path, ord, reason: why a file that stays wants a closer look, in a fixed order. files(path, status, new_mode, gitlink, longest_line)."""
    path, name = F.col("path"), F.lower(F.substring_index("path", "/", -1))
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    suffix = F.regexp_extract(F.substring_index("path", "/", -1), r"^.+(\.[^.]+)$", 1)
    autorun = name.isin(*AUTORUN) | F.lower(F.substring_index(path, "/", -2)).isin(*AUTORUN_PLACES) | F.exists(folders, lambda x: F.lower(x).isin(*AUTORUN_FOLDERS))
    tests = (
        ("nix", suffix == ".nix"),
        ("lockfile", lockfile_kind(path).isNotNull()),
        ("build-script", name == "build.rs"),
        ("install-script", name.rlike(INSTALL) & suffix.isin("", ".sh", ".py", ".ps1", ".bash", ".js")),
        ("package-manifest", name.isin(*MANIFESTS)),
        ("dev-autorun", autorun),
        ("minified-or-vendored", F.contains(name, F.lit(".min.")) | F.arrays_overlap(folders, F.array(*[F.lit(x) for x in VENDORED]))),
        ("symlink", F.col("new_mode") == "120000"),
        ("submodule", F.col("gitlink")),
        ("long-line", F.col("longest_line") > long_line),
    )
    reasons = F.filter(F.array(*[F.when(test, F.struct(F.lit(i).alias("ord"), F.lit(reason).alias("reason"))) for i, (reason, test) in enumerate(tests)]), lambda x: x.isNotNull())
    return files.where("status <> 'deleted'").select("path", F.explode(reasons).alias("r")).select("path", "r.ord", "r.reason")
