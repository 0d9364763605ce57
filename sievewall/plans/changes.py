"""Queries over the review of changes: lockfiles, reviewers' replies, the flow from event to outcome, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewall.functions import rendering
from sievewall.operators import flow, gate, lockfiles
from sievewall.tables import spread

from . import fixtures as fx
from .fixtures import LITERALS, choice, planted, table

# Fixed inputs: what a package is resolved to, and how another is specified.
RESOLVED = ("https://registry.npmjs.org/b.tgz", "http://evil.example/b.tgz", "git+ssh://git@evil.example/o/r.git", "file:../b", "../b", "https://user@registry.npmjs.org/b.tgz", "https://evil.example\\\\@registry.npmjs.org/b")
SPECS = ("^1.0.0", "github:o/r#1", "workspace:*", "file:/abs", "npm:x@1", "odd:thing")


def lock_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package lock for each part: path, head, base; the base is the head of every third, and every eleventh gives a key twice."""
    key = F.col("p_partkey")
    name = key.cast("string")
    doc = F.concat(
        F.lit('{"name": "n'), name, F.lit('", "packages": {"node_modules/a": {"resolved": "https://registry.npmjs.org/a.tgz", "license": "https://evil.example/l", "funding": {"url": "http://evil.example/f"}}, "node_modules/b": {"resolved": "'),
        choice(RESOLVED, key), F.lit('"}, "node_modules/c": {"dependencies": {"d": "'), choice(SPECS, F.floor(key / 7).cast("long")), F.when(key % 13 == 0, '", "funding": "https://evil.example/x').otherwise(""), F.lit('"}}}}'),
    )
    head = F.when(key % 11 == 0, F.replace(doc, F.lit('{"name"'), F.lit('{"name": "", "name"'))).otherwise(doc)
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("p"), name, F.lit("/package-lock.json")).alias("path"), head.alias("head"), F.when(key % 3 == 0, doc).alias("base"))


def lock_file_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = docs.select("path", F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("status"))
    return files, docs.select("path", F.col("head").cast("binary").alias("content")), docs.where("base is not null").select("path", F.col("base").cast("binary").alias("content"))


def lockfile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfiles.parsed_hits(lockfiles.lock_sides(*lock_file_rows(lock_documents(spark, sf_dir))))


def requirement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    index = F.when(key % 4 == 0, "--index-url https://pypi.org\\\n.evil.x/simple\n").when(key % 4 == 1, "--index-url https://pypi.org/simple\n").when(key % 4 == 2, "-ihttps://bad.host/s # c\n").otherwise("x @ https://files.pythonhosted.org/x.whl \\\n  --hash=1\n")
    head = F.concat(F.lit("a=="), key.cast("string"), F.lit("\n# note\n"), index, F.when(key % 5 == 0, "b @ http://pypi.org/b\n").otherwise(""))
    base = F.when(key % 6 == 0, head).when(key % 6 == 1, "a==0\n")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("r"), key.cast("string"), F.lit("/requirements.txt")).alias("path"), head.alias("head"), base.alias("base"))


def requirements_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfiles.requirements_hits(lockfiles.lock_sides(*lock_file_rows(requirement_texts(spark, sf_dir))))


ENDS = ("\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\u2028", "\n\n")


def pip_physical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.concat(F.lit("a"), choice(ENDS, key), F.col("p_name"), choice(ENDS, key + F.col("p_size")), F.lit("b\\"), choice(ENDS, key * 3), F.when(key % 2 == 0, "end").otherwise(""))
    texts = table(spark, sf_dir, "part").select(key.cast("string").alias("path"), text.alias("text"))
    return lockfiles.physical_lines(texts)


def submodule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.submodule_hits(fx.change_files(spark, sf_dir).withColumn("gitlink", F.col("ord") % 10 == 3))


def change_hits(spark: SparkSession, sf_dir: str, always_on: bool = False) -> DataFrame:
    """Hits of several checks over the changed files, end to end."""
    files = fx.change_files(spark, sf_dir)
    named = lambda rows: rows.join(files.select("path", "change_id"), "path")
    hidden = files.where("ord % 31 = 0 and status <> 'deleted'").select("change_id", "path", F.lit("in the file path: U+200B").alias("detail"))
    binary = named(gate.binary_hits(files, files.where("ord % 3 <> 1").select("path", F.unhex(F.when(F.col("ord") % 22 == 0, "89504E470D0A1A0A00").otherwise("0011")).alias("content"))))
    linked = named(gate.submodule_hits(files.withColumn("gitlink", F.col("ord") % 10 == 3)))
    return flow.all_hits(("hidden-unicode", False, hidden), ("binary", True, binary), ("submodule", True, linked), always_on=always_on)


def run_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_hits(spark, sf_dir).groupBy("change_id", "ord", "rule", "overridable").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def always_on_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_hits(spark, sf_dir, True).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


REPLIES = (
    ("monitor", '{"analysis": "a", "suspicion": 5, "findings": []}', True), ("monitor", '{"analysis": "a", "suspicion": 101, "findings": []}', False), ("monitor", '{"analysis": "a", "suspicion": true, "findings": []}', False),
    ("monitor", '{"analysis": "a", "suspicion": 5, "findings": [], "more": 1}', False), ("review", '{"findings": [{"file": "f", "category": "bug", "severity": "low", "explanation": "e"}]}', True),
    ("review", '{"findings": [{"file": "f", "category": "malicious", "severity": "low", "explanation": "e"}]}', False), ("review", '{"findings": [{"file": "f", "category": "bug", "severity": "dire", "explanation": "e"}]}', False),
    ("review", '{"findings": [{"file": "f", "category": "bug", "severity": "low"}]}', False), ("review", '{"findings": {}}', False), ("review", "rubbish", False), ("monitor", '{"findings": []}', False),
    ("monitor", '{"analysis": "a", "suspicion": 100, "findings": [{"file": "f", "category": "malicious", "severity": "high", "explanation": ""}]}', True), ("review", '{"findings": [], "findings": []}', False), ("review", '{"findings": [{"file": 1, "category": "bug", "severity": "low", "explanation": "e"}]}', False),
)


def pass_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key, choice([x[0] for x in REPLIES], key).alias("kind"), choice([x[1] for x in REPLIES], key).alias("reply"))
    return rows.select("p_partkey", flow.valid_reply(F.col("kind"), F.col("reply")).alias("valid"))


HEAD = "a" * 40


def pull_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("change_id"), choice(("auto_merge_enabled", "synchronize", "auto_merge_enabled", "reopened", "closed"), key).alias("action"), (F.when(key % 19 == 0, 2).otherwise(1)).alias("run_attempt"), (key % 71 != 0).alias("keyed"),
        (key % 29 != 0).alias("auto_merge"), F.when(key % 31 == 0, "someone").otherwise("OWNER").alias("enabled_by"), F.when(key % 37 == 0, "b" * 40).otherwise(HEAD).alias("head_sha"), F.when(key % 61 == 0, "x").otherwise(HEAD).alias("event_head"),
        F.when(key % 41 == 0, "dev").otherwise("main").alias("base_ref"), F.lit("main").alias("default_branch"), F.when(key % 43 == 0, "CONFLICTING").when(key % 47 == 0, "UNKNOWN").otherwise("MERGEABLE").alias("mergeable"), (key % 53 != 0).alias("merged_here"),
        F.concat(F.lit("h"), (key % 3).cast("string")).alias("own_hash"),
    )


def pull_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("change_id"), key.alias("review_id"), F.when(key % 3 == 0, "pass").otherwise("block").alias("verdict"), F.when(key % 4 == 0, HEAD).otherwise("c" * 40).alias("head"), F.concat(F.lit("h"), (key % 3).cast("string")).alias("own_hash"),
        choice(("CHANGES_REQUESTED", "DISMISSED", "COMMENTED"), F.floor(key / 4).cast("long")).alias("state"),
    )


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pull_events(spark, sf_dir).select("change_id", F.coalesce(flow.guard("Owner"), F.lit("")).alias("message"))


def marker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flow.marks(pull_markers(spark, sf_dir), pull_events(spark, sf_dir))
    return found.select("change_id", "carried", F.size("blocked").alias("n_blocked"), "blocked_head", F.array_join("states", ",").alias("states"))


def flow_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = pull_events(spark, sf_dir)
    key = F.col("change_id")
    overridden = events.select("change_id", (key % 5 == 0).alias("overridden"))
    always_on = events.select("change_id", (key % 23 == 0).alias("block"), F.when(key % 23 == 0, "deterministic check: hidden-unicode").otherwise("").alias("reasons"))
    n_bytes = events.select("change_id", F.when(key % 59 == 0, 500_000).otherwise(1000).alias("n_bytes"))
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x).alias("name")) for i, x in enumerate(flow.PASSES)]))
    passes = events.select("change_id", names.alias("p")).select("change_id", "p.ord", "p.name").where("change_id % 17 <> 0 or ord > 0")
    status = F.when(key % 13 + F.col("ord") == 3, "infra").otherwise("ok")
    passes = passes.select("change_id", "name", "ord", status.alias("status"), F.when(status == "infra", choice(("api-timeout", "api-status-400", "api-status-429"), key)).otherwise("").alias("reason"), F.when(status == "ok", (key % 101).cast("int")).alias("suspicion"))
    nothing = events.where("false")
    decided = gate.decided(nothing.select("change_id", F.lit("").alias("rule")), passes, nothing.select("change_id", F.lit(0).alias("ord"), F.lit("").alias("category"), F.lit("").alias("severity")), 70)
    full = flow.full_decisions(decided, passes, n_bytes)
    return flow.outcomes(events, flow.marks(pull_markers(spark, sf_dir), events), overridden, always_on, full, "Owner")


def gate_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_outcomes(spark, sf_dir)


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.review_actions(flow_outcomes(spark, sf_dir), pull_markers(spark, sf_dir)).groupBy("change_id", "action").agg(F.count(F.lit(1)).alias("n"))


#: More characters than any text has: nothing is cut.
WHOLE = 1 << 30


def neutralised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, and as a report shows them, cut behind so many characters."""
    text = F.concat(F.lit("@a #1 [x](http://www.e.x) `c` | <b> & gh-1 GH-x \x00"), F.col("text"), F.lit(" www.e.x "))
    lines = planted(spark, sf_dir).select("doc_id", rendering.one_line(text).alias("line"))
    return lines.select("doc_id", rendering.neutralised_line(F.col("line"), 80).alias("head"), F.sha2(rendering.neutralised_line(F.col("line"), WHOLE), 256).alias("whole_sha256"))


def scrubbed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", F.sha2(rendering.scrubbed(F.concat(F.lit("\x1b[1m \x85"), "text"), WHOLE), 256).alias("said_sha256"))


def escaped_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(rendering.escaped_command(F.concat(F.lit("100%\r"), F.coalesce("text", F.lit("")))), 256).alias("command_sha256"))


def review_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.change_files(spark, sf_dir)
    hits = files.where("ord % 2 = 0").select("change_id", "ord", F.lit("binary").alias("rule"), "path", F.lit("content is png").alias("detail"), (F.col("ord") % 4 == 0).alias("overridable"))
    found = files.where("ord % 3 = 0").select("change_id", "ord", F.lit("bug").alias("category"), choice(("low", "high", "medium"), F.col("ord")).alias("severity"), F.col("path").alias("file"), F.lit("review").alias("source"), F.concat(F.lit("see http://x.y <i>"), F.col("ord").cast("string")).alias("explanation"))
    decisions = files.groupBy("change_id").agg(F.lit(True).alias("block"), F.array(F.concat(F.lit("files: "), F.count(F.lit(1)).cast("string"))).alias("reasons"))
    scrutiny = files.where("ord % 7 = 0").select("change_id", F.lit(0).alias("ord"), "path", F.lit("long-line").alias("reason"))
    return flow.review_bodies(decisions, hits, found, scrutiny)


QUERIES = (
    lockfile_findings, requirements_findings, pip_physical_lines, submodule_hits, run_all_checks, always_on_checks, pass_replies, preflight, marker_state, gate_flow, review_actions,
    neutralised_text, scrubbed_messages, escaped_commands, review_body,
)

L = LITERALS
EVENTS = f"""
events_of AS (SELECT c_custkey AS k, ['auto_merge_enabled', 'synchronize', 'auto_merge_enabled', 'reopened', 'closed'][c_custkey % 5 + 1] AS action, CASE WHEN c_custkey % 19 = 0 THEN 2 ELSE 1 END AS attempt, c_custkey % 71 <> 0 AS keyed,
  CASE WHEN c_custkey % 29 = 0 THEN 'enable auto-merge to request the AI gate' WHEN c_custkey % 31 = 0 THEN 'auto-merge must be enabled by Owner' WHEN (c_custkey % 37 = 0) OR (c_custkey % 61 = 0) THEN 'stale: the PR head moved since this event' WHEN c_custkey % 41 = 0 THEN 'the AI gate only reviews PRs into main' ELSE '' END AS guard,
  CASE WHEN c_custkey % 61 = 0 THEN 'x' ELSE '{HEAD}' END AS head, 'h' || (c_custkey % 3) AS own FROM customer),
markers AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'pass' ELSE 'block' END AS verdict, CASE WHEN o_orderkey % 4 = 0 THEN '{HEAD}' ELSE '{"c" * 40}' END AS head, 'h' || (o_orderkey % 3) AS own, ['CHANGES_REQUESTED', 'DISMISSED', 'COMMENTED'][o_orderkey // 4 % 3 + 1] AS state FROM orders),
marked AS (SELECT e.k, max_by(m.verdict || m.own, m.id) = 'pass' || any_value(e.own) AS carried, count(*) FILTER (WHERE m.verdict = 'block' AND m.head = e.head AND m.own = e.own) AS n_blocked, count(*) FILTER (WHERE m.verdict = 'block' AND m.head = e.head) > 0 AS blocked_head,
  coalesce(string_agg(DISTINCT m.state, ',' ORDER BY m.state) FILTER (WHERE m.verdict = 'block' AND m.head = e.head AND m.own = e.own), '') AS states FROM events_of e JOIN markers m ON e.k = m.k GROUP BY e.k)
"""
FLOW = f"""
{EVENTS}, passes AS (SELECT k, o, CASE WHEN k % 13 + o = 3 THEN 'infra' ELSE 'ok' END AS status, name FROM events_of, (VALUES (0, 'monitor_a'), (1, 'monitor_b'), (2, 'review')) v(o, name) WHERE k % 17 <> 0 OR o > 0),
tops AS (SELECT k, count(*) FILTER (WHERE status = 'infra') AS infra, string_agg(name, '') FILTER (WHERE status = 'infra') AS failed, max(CASE WHEN status = 'ok' THEN k % 101 END) AS suspicion FROM passes GROUP BY k),
whole AS (SELECT e.k, k59, t.infra, t.failed || ': ' || ['api-timeout', 'api-status-400', 'api-status-429'][e.k % 3 + 1] AS said, array_to_string(list_filter([CASE WHEN suspicion >= 70 THEN 'suspicion ' || suspicion || ' >= threshold 70' END, CASE WHEN e.k % 17 = 0 AND NOT k59 THEN 'reviewer passes missing or malformed' END], lambda x: x IS NOT NULL), '; ') AS reasons
  FROM (SELECT k, k % 59 = 0 AS k59 FROM events_of) e JOIN tops t ON e.k = t.k),
stops AS (SELECT e.k, action IN ('synchronize', 'reopened') AS pushed, coalesce(n_blocked, 0) > 0 AS blocked, w.reasons, w.infra,
  CASE WHEN action = 'closed' THEN 'unsupported pull_request_target action' WHEN head = 'x' THEN 'event has no valid head SHA' WHEN NOT keyed THEN 'config: the marker key is empty' WHEN guard <> '' THEN guard
    WHEN e.k % 43 = 0 THEN 'the PR has conflicts with its base' WHEN e.k % 47 = 0 OR e.k % 53 = 0 THEN 'infra: the test merge is not computed; re-run this check or toggle auto-merge'
    WHEN action <> 'auto_merge_enabled' AND NOT coalesce(carried, false) THEN 'the PR was pushed to or reopened after auto-merge was enabled; disable and re-enable auto-merge to re-request review'
    WHEN action <> 'auto_merge_enabled' THEN NULL
    WHEN coalesce(n_blocked, 0) > 0 THEN CASE WHEN e.k % 5 = 0 THEN NULL WHEN contains(states, 'CHANGES_REQUESTED') THEN 'the gate blocked this commit; Owner must dismiss its review to override, then re-run this check' WHEN NOT contains(states, 'DISMISSED') THEN 'the gate blocked this commit; a comment cannot be dismissed' ELSE 'the gate blocked this commit and its dismissal does not count' END
    WHEN attempt > 1 THEN CASE WHEN coalesce(blocked_head, false) THEN 'a verified block of this head is of another base' ELSE 'a re-run never asks the model again' END
    WHEN w.infra > 0 THEN CASE WHEN e.k % 3 = 1 THEN 'config: the model API rejected the request (' || said || ')' ELSE 'infra: model call failed (' || said || '); re-run this check or toggle auto-merge' END END AS stop
  FROM events_of e LEFT JOIN marked m ON e.k = m.k JOIN whole w ON w.k = e.k),
modes AS (SELECT *, CASE WHEN stop IS NULL THEN CASE WHEN pushed THEN 'carry-over' WHEN blocked THEN 'owner-override' ELSE 'full' END END AS mode FROM stops),
outcomes AS (SELECT k AS change_id, mode, CAST(CASE WHEN stop IS NOT NULL OR (mode = 'full' AND reasons <> '') OR (mode <> 'full' AND k % 23 = 0) THEN 1 ELSE 0 END AS INTEGER) AS exit_code,
  CASE WHEN stop IS NOT NULL THEN stop WHEN mode = 'full' AND reasons <> '' THEN 'blocked: ' || reasons WHEN mode <> 'full' AND k % 23 = 0 THEN 'blocked: deterministic check: hidden-unicode' ELSE 'passed (' || mode || ')' END AS message FROM modes)
"""


def neutral(text: str, limit: int) -> str:
    """The same steps in SQL; what is not printable is written out for the planted texts."""
    hidden = r"[\x{AD}\x{061C}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{FE00}-\x{FE0F}\x{E000}-\x{F8FF}\x{E0000}-\x{E01EF}]"
    shown = f"array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN regexp_full_match(c, '{hidden}') THEN printf('<U+%04X>', unicode(c)) ELSE c END), '')"
    line = rf"trim(regexp_replace(regexp_replace({shown}, '[\x00-\x1F\x7F-\xA0]', ' ', 'g'), ' +', ' ', 'g'))"
    cut = f"CASE WHEN length({line}) > {limit} THEN substr({line}, 1, {limit}) || '…' ELSE {line} END"
    flat = f"replace(replace(replace(translate({cut}, '@#[]`|', '＠＃［］ˋ¦'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return rf"regexp_replace(replace(regexp_replace({flat}, '(?i)\b(gh)-([0-9])', '\1－\2', 'g'), '://', '[:]//'), '(?i)\bwww\.', 'www[.]', 'g')"


SHOWN = "'@a #1 [x](http://www.e.x) `c` | <b> & gh-1 GH-x ' || chr(0) || text || ' www.e.x '"
SQL = {
    "lockfile_findings": f"""WITH d AS (SELECT p_partkey AS k, {L(RESOLVED)}[p_partkey % {len(RESOLVED)} + 1] AS r, {L(SPECS)}[p_partkey // 7 % {len(SPECS)} + 1] AS s FROM part),
        w AS (SELECT k, unnest(list_filter([
            CASE WHEN NOT starts_with(r, 'https:') AND NOT starts_with(r, 'file:') THEN 'fetch slot that is not an https URL or a local path' END,
            CASE WHEN starts_with(r, 'http:') THEN 'http://evil.example' WHEN starts_with(r, 'git+ssh:') THEN 'git+ssh://evil.example' WHEN contains(r, 'user@') THEN 'https://registry.npmjs.org' WHEN contains(r, 'evil.example') THEN 'https://evil.example' END,
            CASE WHEN starts_with(r, 'git+ssh:') THEN 'hosted-git spec git+ssh:' WHEN starts_with(s, 'github:') THEN 'hosted-git spec github:' END,
            CASE WHEN starts_with(r, 'git+ssh:') AND starts_with(s, 'github:') THEN 'hosted-git spec github:' END,
            CASE WHEN s = 'file:/abs' THEN 'file: reference that is not a relative path' WHEN s = 'odd:thing' THEN 'package spec protocol odd:' END,
            CASE WHEN k % 13 = 0 THEN 'https://evil.example' END], lambda x: x IS NOT NULL)) AS what FROM d WHERE k % 3 <> 0 AND k % 11 <> 0)
        SELECT 'p' || k || '/package-lock.json' AS path, 'not allowlisted: ' || list_aggregate(list_slice(list_sort(list_distinct(list(what))), 1, 4), 'string_agg', ', ') AS detail FROM w GROUP BY k
        UNION ALL SELECT 'p' || p_partkey || '/package-lock.json', 'lockfile does not parse' FROM part WHERE p_partkey % 11 = 0""",
    "requirements_findings": """WITH r AS (SELECT p_partkey AS k, 'r' || p_partkey || '/requirements.txt' AS path FROM part WHERE p_partkey % 6 <> 0)
        SELECT path, CAST(3 AS BIGINT) AS line_no, 'line 3: not allowlisted: ' || CASE WHEN k % 4 = 0 THEN 'https://pypi.org.evil.x' ELSE 'https://bad.host' END AS detail FROM r WHERE k % 4 IN (0, 2)
        UNION ALL SELECT path, CASE WHEN k % 4 IN (0, 3) THEN 5 ELSE 4 END, 'line ' || CASE WHEN k % 4 IN (0, 3) THEN 5 ELSE 4 END || ': not allowlisted: http://pypi.org' FROM r WHERE k % 5 = 0""",
    "pip_physical_lines": rf"""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS path, 'a' || {L(ENDS)}[p_partkey % {len(ENDS)} + 1] || p_name || {L(ENDS)}[(p_partkey + p_size) % {len(ENDS)} + 1] || 'b\' || {L(ENDS)}[p_partkey * 3 % {len(ENDS)} + 1] || CASE WHEN p_partkey % 2 = 0 THEN 'end' ELSE '' END AS text FROM part),
        s AS (SELECT path, string_split(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n', chr(1) || 'N', 'g'), '[\r\x0B\x1C\x{{85}}\x{{2028}}]', chr(1) || '-', 'g'), chr(1)) AS parts FROM t),
        u AS (SELECT path, unnest(range(len(parts))) AS part, unnest(parts) AS piece, len(parts) AS n FROM s)
        SELECT path, 1 + sum(CASE WHEN part > 0 AND starts_with(piece, 'N') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY part) AS line_no, CAST(part AS INTEGER) AS part, CASE WHEN part > 0 THEN substr(piece, 2) ELSE piece END AS line FROM u
        QUALIFY part < n - 1 OR length(piece) > 1""",
    "submodule_hits": f"WITH {fx.CHANGE_FILES} SELECT path, 'submodule pointer: its content is not reviewed; check the target repo/commit before dismissing' AS detail FROM change_files WHERE ord % 10 = 3 AND status <> 'deleted'",
    "run_all_checks": f"""WITH {fx.CHANGE_FILES}, h AS (SELECT change_id, 0 AS ord, 'hidden-unicode' AS rule, false AS overridable, path FROM change_files WHERE ord % 31 = 0 AND status <> 'deleted'
          UNION ALL SELECT change_id, 1, CASE WHEN ends_with(path, '.png') THEN 'binary' ELSE 'text-binary' END, ends_with(path, '.png'), path FROM change_files WHERE binary_file AND status <> 'deleted'
          UNION ALL SELECT change_id, 2, 'submodule', true, path FROM change_files WHERE ord % 10 = 3 AND status <> 'deleted')
        SELECT change_id, ord, rule, overridable, count(*) AS n, min(path) AS first_path FROM h GROUP BY ALL""",
    "always_on_checks": f"""WITH {fx.CHANGE_FILES} SELECT 'hidden-unicode' AS rule, count(*) AS n FROM change_files WHERE ord % 31 = 0 AND status <> 'deleted' HAVING count(*) > 0
        UNION ALL SELECT 'text-binary', count(*) FROM change_files WHERE binary_file AND status <> 'deleted' AND NOT ends_with(path, '.png')""",
    "pass_replies": f"SELECT p_partkey, [{', '.join(str(x[2]).lower() for x in REPLIES)}][p_partkey % {len(REPLIES)} + 1] AS valid FROM part",
    "preflight": f"WITH {EVENTS} SELECT k AS change_id, guard AS message FROM events_of",
    "marker_state": f"WITH {EVENTS} SELECT k AS change_id, carried, CAST(n_blocked AS INTEGER) AS n_blocked, blocked_head, states FROM marked",
    "gate_flow": f"WITH {FLOW} SELECT * FROM outcomes",
    "review_actions": f"""WITH {FLOW} SELECT change_id, CASE WHEN exit_code = 1 THEN 'request-changes' ELSE 'comment' END AS action, CAST(1 AS BIGINT) AS n FROM outcomes WHERE mode IS NOT NULL
        UNION ALL SELECT change_id, 'dismiss', count(*) FROM outcomes JOIN markers m ON m.k = change_id WHERE mode IS NOT NULL AND exit_code = 0 AND m.verdict = 'block' AND m.state = 'CHANGES_REQUESTED' GROUP BY change_id""",
    "neutralised_text": f"""WITH {fx.PLANTED} SELECT doc_id, {neutral("(" + SHOWN + ")", 80)} AS head, sha256({neutral("(" + SHOWN + ")", WHOLE)}) AS whole_sha256 FROM planted""",
    "scrubbed_messages": rf"""WITH {fx.PLANTED}, t AS (SELECT doc_id, text FROM planted)
        SELECT doc_id, sha256(substr(trim(regexp_replace(translate(nfc_normalize(replace(replace(translate(regexp_replace(regexp_replace(substr(chr(27) || '[1m ' || chr(133) || text, 1, 16384), '[\x00-\x1F\x7F-\x9F]', ' ', 'g'), '[\x{{200B}}\x{{202E}}\x{{2061}}\x{{E0041}}]', '', 'g'), chr(65313), 'A'), chr(64257), 'fi'), chr(189), '1' || chr(8260) || '2')), chr(8260) || chr(8725), '//'), '[\x09-\x0D\x20\x{{A0}}]+', ' ', 'g')), 1, {WHOLE})) AS said_sha256 FROM t""",
    "escaped_commands": "SELECT doc_id, sha256(replace(replace(replace('100%' || chr(13) || coalesce(text, ''), '%', '%25'), chr(13), '%0D'), chr(10), '%0A')) AS command_sha256 FROM documents",
    "review_body": f"""WITH {fx.CHANGE_FILES}, h AS (SELECT change_id, string_agg('- binary' || CASE WHEN ord % 4 = 0 THEN '' ELSE ' (not clearable by override)' END || ': ' || path || ': content is png', chr(10) || chr(10) ORDER BY ord) AS s FROM change_files WHERE ord % 2 = 0 GROUP BY change_id),
        f AS (SELECT change_id, string_agg('- ' || ['low', 'high', 'medium'][ord % 3 + 1] || ' · bug · ' || path || ' (review): see http[:]//x.y &lt;i&gt;' || ord, chr(10) || chr(10) ORDER BY list_position(['high', 'medium', 'low'], ['low', 'high', 'medium'][ord % 3 + 1]), ord) AS s FROM change_files WHERE ord % 3 = 0 GROUP BY change_id),
        c AS (SELECT change_id, string_agg('- ' || path || ': long-line', chr(10) || chr(10) ORDER BY path) AS s FROM change_files WHERE ord % 7 = 0 GROUP BY change_id), n AS (SELECT change_id, count(*) AS n FROM change_files GROUP BY change_id)
        SELECT n.change_id, concat_ws(chr(10) || chr(10), '### AI gate: BLOCKED', '**Why it blocks**', '- files: ' || n, '**Deterministic checks**' || chr(10) || chr(10) || h.s, '**Findings** (model-written, untrusted plain text)' || chr(10) || chr(10) || f.s, '**Extra scrutiny** (not blocking)' || chr(10) || chr(10) || c.s,
          '**To clear a false alarm:** the owner dismisses this review, then re-runs the failed ai-gate check. Hidden-Unicode, lockfile-host and text-binary hits cannot be cleared that way: fix the change instead.') AS body
        FROM n LEFT JOIN h ON n.change_id = h.change_id LEFT JOIN f ON n.change_id = f.change_id LEFT JOIN c ON n.change_id = c.change_id""",
}
