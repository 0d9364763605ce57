"""The review end to end on changes whose diffs, contents and signed markers are made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewall.operators import flow, markers, review

from .changes import HEAD
from .fixtures import choice, table

OWNER, KEY = "Owner", b"a key of the review"
EXCEPTIONS = [".github/ok*"]
# A change for each shape: what it does, as a diff with the part's number for @K; the rules that it breaks, and which of them nothing clears.
EVIL = '{"packages": {"node_modules/a": {"resolved": "http://evil.example/a.tgz"}}}'
SHAPES = (
    ("diff --git a/src/f@K.py b/src/f@K.py\n--- a/src/f@K.py\n+++ b/src/f@K.py\n@@ -1 +1 @@\n-x\n+y @N\n", (), ()),
    ("diff --git a/h@K.md b/h@K.md\n--- a/h@K.md\n+++ b/h@K.md\n@@ -0,0 +1,2 @@\n+@N\n+hid​​den\n", ("hidden-unicode",), ("hidden-unicode",)),
    ("diff --git a/w/package-lock.json b/w/package-lock.json\n--- a/w/package-lock.json\n+++ b/w/package-lock.json\n@@ -1 +1 @@\n-{}\n+@N\n", ("lockfile-host",), ("lockfile-host",)),
    ("diff --git a/i@K.png b/i@K.png\nindex 1..2 100644\nBinary files a/i@K.png and b/i@K.png differ\n", ("binary",), ()),
    ("diff --git a/b@K.js b/b@K.js\nindex 1..2 100644\nBinary files a/b@K.js and b/b@K.js differ\ndiff --git a/sub@K b/sub@K\nindex 1..2 160000\n--- a/sub@K\n+++ b/sub@K\n@@ -1 +1 @@\n-Subproject commit 1\n+Subproject commit @K\n", ("submodule", "text-binary"), ("text-binary",)),
    ("diff --git a/.github/workflows/ci@K.yml b/.github/workflows/ci@K.yml\n--- a/.github/workflows/ci@K.yml\n+++ b/.github/workflows/ci@K.yml\n@@ -1 +1 @@\n-x\n+y\n", ("sensitive-path",), ()),
    ("diff --git a/old@K.py b/new@K.py\nsimilarity index 100%\nrename from old@K.py\nrename to new@K.py\n", ("text-binary",), ("text-binary",)),
    ("diff --git a/req/requirements.txt b/req/requirements.txt\n--- a/req/requirements.txt\n+++ b/req/requirements.txt\n@@ -1 +1 @@\n-a==1\n+a==2\ndiff --git a/.github/ok@K.md b/.github/ok@K.md\nold mode 100644\nnew mode 100755\n", (), ()),
    ("diff --git a/r@K.bin b/r2@K.bin\nsimilarity index 100%\nrename from r@K.bin\nrename to r2@K.bin\n", ("too-large",), ()),
    ("diff --git a/cut@K b/cut@K\n--- a/cut@K\n+++ b/cut@K\n@@ -1,2 +1,3 @@\n keep\n", None, None),
)
#: Every so many parts' diff is beyond what reviewers read.
LARGE = 307


def change_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.replace(F.replace(choice([x for x, _, _ in SHAPES], key), F.lit("@K"), key.cast("string")), F.lit("@N"), F.col("p_name"))
    long = F.concat(F.lit("\ndiff --git a/long b/long\n--- a/long\n+++ b/long\n@@ -1 +1 @@\n-x\n+"), F.repeat(F.lit("y"), flow.MODEL_CAP), F.lit("\n"))
    return table(spark, sf_dir, "part").select(key.alias("change_id"), F.when((key % LARGE == 0) & (key % len(SHAPES) == 0), F.concat(F.rtrim(text, F.lit("\n")), long)).otherwise(text).alias("diff"))


def change_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at the head and the base of the changed files; null is over the cap."""
    key, name = F.col("p_partkey"), F.col("p_partkey").cast("string")
    shape = key % len(SHAPES)
    item = lambda side, path, content: F.struct(F.lit(side).alias("side"), path.alias("path"), content.cast("binary").alias("content"))
    named = lambda x, end: F.concat(F.lit(x), name, F.lit(end))
    found = (
        F.when(shape == 2, F.array(item("head", F.lit("w/package-lock.json"), F.lit(EVIL)), item("base", F.lit("w/package-lock.json"), F.lit("{}"))))
        .when(shape == 3, F.array(item("head", named("i", ".png"), F.unhex(F.lit("89504E470D0A1A0A00")))))
        .when(shape == 4, F.array(item("head", named("b", ".js"), F.unhex(F.lit("0011")))))
        .when(shape == 6, F.array(item("head", named("new", ".py"), F.unhex(F.lit("610062")))))
        .when(shape == 7, F.array(item("head", F.lit("req/requirements.txt"), F.lit("a==2\n")), item("base", F.lit("req/requirements.txt"), F.lit("a==1\n"))))
        .when(shape == 8, F.array(item("head", named("r2", ".bin"), F.lit(None).cast("string"))))
    )
    return table(spark, sf_dir, "part").select(key.alias("change_id"), F.explode(found).alias("c")).select("change_id", "c.*")


def pull_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("change_id"), F.when(key % 3 == 0, "synchronize").when(key % 97 == 0, "closed").otherwise("auto_merge_enabled").alias("action"), F.lit(1).alias("run_attempt"), F.lit(True).alias("keyed"), (key % 23 != 0).alias("auto_merge"), F.lit("OWNER").alias("enabled_by"),
        F.lit(HEAD).alias("head_sha"), F.lit(HEAD).alias("event_head"), F.lit("main").alias("base_ref"), F.lit("main").alias("default_branch"), F.when(key % 43 == 0, "CONFLICTING").otherwise("MERGEABLE").alias("mergeable"), F.lit(True).alias("merged_here"),
    )


def posted_reviews(spark: SparkSession, sf_dir: str, g: review.Gathered) -> DataFrame:
    """A signed review of each change, of its own hash but for every seventh, whose signature is not ours for every eleventh: a pass where pushes carry it over, a block on every fifth other."""
    hashes = markers.changes_hash(g.files)
    key = F.col("change_id")
    own = hashes.select(key, F.when(key % 7 == 0, F.sha2(key.cast("string").cast("binary"), 256)).otherwise(F.col("own_hash")).alias("own_hash"), F.when(key % 3 == 0, "pass").otherwise("block").alias("verdict")).where((key % 3 == 0) | (key % 5 == 0))
    rest = F.lit("\nreview text\n")
    macs = [markers.signature(k, F.col("verdict"), F.lit("own/repo"), key, F.lit(HEAD), F.col("own_hash"), rest) for k in (KEY, b"another key")]
    body = F.concat(markers.marker_line(F.col("verdict"), F.lit(HEAD), F.col("own_hash"), F.when(key % 11 == 0, macs[1]).otherwise(macs[0])), rest)
    return own.select("change_id", F.lit("own/repo").alias("repo"), key.alias("number"), (key * 10).alias("review_id"), body.alias("body"), F.lit("CHANGES_REQUESTED").alias("state"))


def full_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From diffs, contents, reviews and reviewers' passes to outcomes; the owner dismissed the block of every other blocked change."""
    g = review.gathered(change_texts(spark, sf_dir), change_contents(spark, sf_dir))
    events = pull_states(spark, sf_dir)
    reviews = posted_reviews(spark, sf_dir, g)
    timeline = reviews.select("change_id", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("reviewed").alias("kind"), F.lit("bot").alias("actor")), F.struct(F.lit(2).alias("ord"), F.when(F.col("change_id") % 2 == 0, "dismissed").otherwise("seen").alias("kind"), F.lit("owner").alias("actor")))).alias("t"), "review_id").select("change_id", "t.*", "review_id")
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x).alias("name")) for i, x in enumerate(flow.PASSES)]))
    passes = events.select("change_id", names.alias("p")).select("change_id", "p.ord", "p.name", F.lit("ok").alias("status"), F.lit("").alias("reason"), F.when(F.col("change_id") % 13 == 0, 90).otherwise(5).alias("suspicion"))
    findings = events.where("change_id % 19 = 0").select("change_id", F.lit(0).alias("ord"), F.lit("malicious").alias("category"), F.lit("high").alias("severity"))
    return review.reviewed(g, events, reviews, timeline, passes, findings, OWNER, KEY, EXCEPTIONS)


def all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks on the same changes."""
    g = review.gathered(change_texts(spark, sf_dir), change_contents(spark, sf_dir))
    return review.checked(g, EXCEPTIONS).select("change_id", "ord", "rule", "path", "detail", "overridable")


def scrutiny_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = review.gathered(change_texts(spark, sf_dir), change_contents(spark, sf_dir))
    return review.looked_at(g, EXCEPTIONS).select("change_id", "ord", "path", "reason")


QUERIES = (full_gate, all_checks, scrutiny_of_changes)

N = len(SHAPES)
OF_SHAPES = lambda at: "[" + ", ".join("NULL" if s[at] is None else "'" + "; ".join(f"deterministic check: {r}" for r in s[at]) + "'" for s in SHAPES) + "]"
RETRIES = "disable and re-enable auto-merge to re-request review"
SQL = {
    "full_gate": f"""WITH k AS (SELECT p_partkey AS k, p_partkey % {N} AS s, p_partkey % {LARGE} = 0 AND p_partkey % {N} = 0 AS large, p_partkey % 3 = 0 AS pushed, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS own FROM part),
        c AS (SELECT *, {OF_SHAPES(1)}[s + 1] || CASE WHEN large THEN 'deterministic check: too-large' ELSE '' END AS rules, {OF_SHAPES(2)}[s + 1] AS kept, NOT pushed AND k % 5 = 0 AND own AS blocked FROM k),
        o AS (SELECT *, concat_ws('; ', nullif(rules, ''), CASE WHEN k % 13 = 0 THEN 'suspicion 90 >= threshold 70' END, CASE WHEN k % 19 = 0 THEN 'finding: malicious (high)' END) AS reasons,
          CASE WHEN NOT pushed AND k % 97 = 0 THEN 'unsupported pull_request_target action' WHEN k % 23 = 0 THEN 'enable auto-merge to request the AI gate' WHEN k % 43 = 0 THEN 'the PR has conflicts with its base' WHEN s = 9 THEN 'could not parse the diff; human review needed'
            WHEN pushed AND NOT own THEN 'the PR was pushed to or reopened after auto-merge was enabled; {RETRIES}' WHEN blocked AND k % 2 <> 0 THEN 'the gate blocked this commit; {OWNER} must dismiss its review to override, then re-run this check' END AS stop FROM c),
        m AS (SELECT *, CASE WHEN stop IS NULL THEN CASE WHEN pushed THEN 'carry-over' WHEN blocked THEN 'owner-override' ELSE 'full' END END AS mode, CASE WHEN pushed OR blocked THEN kept ELSE reasons END AS why FROM o)
        SELECT k AS change_id, mode, CAST(CASE WHEN stop IS NOT NULL OR why <> '' THEN 1 ELSE 0 END AS INTEGER) AS exit_code, CASE WHEN stop IS NOT NULL THEN stop WHEN why <> '' THEN 'blocked: ' || why ELSE 'passed (' || mode || ')' END AS message FROM m""",
    "all_checks": f"""WITH k AS (SELECT p_partkey AS k, p_partkey % {N} AS s FROM part)
        SELECT k AS change_id, CAST(0 AS INTEGER) AS ord, 'hidden-unicode' AS rule, 'h' || k || '.md' AS path, 'line 2: U+200B' AS detail, false AS overridable FROM k WHERE s = 1 UNION ALL SELECT k, 1, 'lockfile-host', 'w/package-lock.json', 'not allowlisted: fetch slot that is not an https URL or a local path, http://evil.example', false FROM k WHERE s = 2
        UNION ALL SELECT k, 2, 'binary', 'i' || k || '.png', 'content is png', true FROM k WHERE s = 3 UNION ALL SELECT k, 2, 'text-binary', 'b' || k || '.js', 'not a known binary type', false FROM k WHERE s = 4 UNION ALL SELECT k, 2, 'text-binary', 'new' || k || '.py', 'not a known binary type', false FROM k WHERE s = 6
        UNION ALL SELECT k, 3, 'submodule', 'sub' || k, 'submodule pointer: its content is not reviewed; check the target repo/commit before dismissing', true FROM k WHERE s = 4 UNION ALL SELECT k, 4, 'sensitive-path', '.github/workflows/ci' || k || '.yml', 'github', true FROM k WHERE s = 5
        UNION ALL SELECT k, 5, 'too-large', 'r2' || k || '.bin', '{review.UNREAD}', true FROM k WHERE s = 8
        UNION ALL SELECT k, 5, 'too-large', '(whole diff)', 'diff is too large for the AI gate (' || n || ' bytes, limit {flow.MODEL_CAP}); human review', true FROM (SELECT p_partkey AS k, {flow.MODEL_CAP} + octet_length(encode(replace(replace('{SHAPES[0][0].replace(chr(10), "~")}', '@K', CAST(p_partkey AS VARCHAR)), '@N', p_name))) + {len("diff --git a/long b/long~--- a/long~+++ b/long~@@ -1 +1 @@~-x~+~")} AS n FROM part WHERE p_partkey % {LARGE} = 0 AND p_partkey % {N} = 0)""",
    "scrutiny_of_changes": f"""WITH k AS (SELECT p_partkey AS k, p_partkey % {N} AS s FROM part) SELECT k AS change_id, CAST(1 AS INTEGER) AS ord, 'w/package-lock.json' AS path, 'lockfile' AS reason FROM k WHERE s = 2 UNION ALL SELECT k, 1, 'req/requirements.txt', 'lockfile' FROM k WHERE s = 7 UNION ALL SELECT k, 8, 'sub' || k, 'submodule' FROM k WHERE s = 4
        UNION ALL SELECT k, -1, '.github/ok' || k || '.md', 'github' FROM k WHERE s = 7
        UNION ALL SELECT k, 9, 'long', 'long-line' FROM k WHERE k % {LARGE} = 0 AND s = 0""",
}
