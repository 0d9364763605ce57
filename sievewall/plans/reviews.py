"""Queries over panels, evaluation and the review of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewall.functions import replies, urls
from sievewall.operators import evaluation, gate, panels

from . import fixtures as fx
from .fixtures import table

FLOOR = 2
EXCEPTIONS = [".github/x*.md", "docs/d1*/CLAUDE.md", ".github/workflows/*"]
OWNER = "Clerk#000000001"


def panel_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.panel_outcome(fx.panel_votes(spark, sf_dir), FLOOR)


def panel_summary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panels.panel_outcome(fx.panel_votes(spark, sf_dir), FLOOR)
    summary = panels.panel_summary(F.col("outcome"), F.col("verdicts"), 2, FLOOR)
    return found.select("doc_id", summary.alias("summary"), panels.outcome_of(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), summary)).otherwise(summary)).alias("outcome"))


def honeypot_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.honeypot_outcome(fx.honeypot_results(spark, sf_dir))


def judge_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.judge_outcome(fx.judge_votes(spark, sf_dir), 2)


def arbitration_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.arbitration(panel_outcome(spark, sf_dir), honeypot_reduce(spark, sf_dir), judge_unanimous(spark, sf_dir))


def canary_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    canaries = [("C0", "the and"), ("C1", "of the"), ("C2", "der die")]
    calls = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("C"), (F.col("conv_id") % 3).cast("string")).alias("own"), F.col("turn").alias("call_ord"), F.col("role").alias("tool"), F.coalesce("text", F.lit("")).alias("args")
    )
    return panels.canary_contacts(calls, canaries)


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scorecard(evaluation.settled_attempts(fx.attempts(spark, sf_dir)))


def first_attempt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.first_attempt_rates(evaluation.settled_attempts(fx.attempts(spark, sf_dir)))


def fn_fp_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = evaluation.wrong_ids(evaluation.settled_attempts(fx.attempts(spark, sf_dir).withColumn("ord", -F.col("id"))))
    return wrong.select("kind", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def infra_reason_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = arbitration_route(spark, sf_dir)
    return route.select("doc_id", "reason", evaluation.is_outage(F.col("reason")).alias("outage"))


def host_allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("ththth.example.org",), ("tionsh.example.net",)], "host string")
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).join(F.broadcast(allowed), "host", "left_anti").select("page_id", "host")


def multiset_new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("what"), F.concat("l_linestatus", (F.col("l_quantity") % 7).cast("int").cast("string")).alias("value"), "l_orderkey")
    return gate.new_findings(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a requirements file for each customer nation: path, version, line_no, line."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") % 10).cast("string").alias("path"), (F.col("c_custkey") % 2).alias("version"), F.col("c_custkey").alias("line_no"),
        F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("# note "), "c_mktsegment")).when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("\\"), "c_mktsegment", F.lit("==\\"))).otherwise(F.concat("c_mktsegment", F.lit("=="), (F.col("c_custkey") % 11).cast("string"))).alias("line"),
    )


LINES = r"""
lines AS (
  SELECT CAST(c_nationkey % 10 AS VARCHAR) AS path, c_custkey % 2 AS version, c_custkey AS line_no,
    CASE WHEN c_custkey % 7 = 0 THEN '# note ' || c_mktsegment WHEN c_custkey % 5 = 0 THEN '\' || c_mktsegment || '==\' ELSE c_mktsegment || '==' || (c_custkey % 11) END AS line
  FROM customer
)
"""


def row_number_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    return gate.new_lines(lines.where("version = 0").drop("version"), lines.where("version = 1").drop("version"))


def pip_logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.logical_lines(lines_of(spark, sf_dir).drop("version"))


def magic_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.change_files(spark, sf_dir)
    head = F.when(F.col("ord") % 22 == 0, "89504E470D0A1A0A00").when(F.col("ord") % 33 == 0, "474946383961").when(F.col("ord") % 14 == 0, "2321").otherwise("0011")
    contents = files.where("ord % 3 <> 1").select("path", F.unhex(head).alias("content"))
    return gate.binary_hits(files, contents)


def glob_exempt_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.sensitive_paths(fx.change_files(spark, sf_dir), EXCEPTIONS)


def gate_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.change_files(spark, sf_dir)
    hits = files.where("binary and ord % 5 = 0").select("change_id", F.when(F.col("ord") % 2 == 0, "binary").otherwise("text-binary").alias("rule"))
    names = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x).alias("name")) for i, x in enumerate(("intent", "code", "deps"))])
    passes = files.select("change_id").distinct().select("change_id", F.explode(names).alias("p")).select("change_id", "p.name", "p.ord")
    state = (F.col("change_id") + F.col("ord") * 3) % 10
    passes = passes.select("change_id", "name", "ord", F.when(state == 0, "incomplete").when(state == 1, "infra").otherwise("ok").alias("status"), F.when(state == 0, "cut-off").when(state == 1, "api-timeout").otherwise("").alias("reason"), (F.col("change_id") * 17 % 101 - F.col("ord")).cast("int").alias("suspicion"))
    return gate.decided(hits, passes, fx.findings(spark, sf_dir), 70)


def severity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.top_findings(fx.findings(spark, sf_dir), 40)


def reviews_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit(":"), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("change_id"), F.col("o_orderkey").alias("review_id"), marker.alias("marker"))


def newest_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.newest_marker(reviews_of(spark, sf_dir))


def timeline_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        (F.col("user_id") % 60).alias("change_id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 37 == 0, "rewrite").when(F.col("event_id") % 2 == 0, "reviewed").otherwise("dismissed").alias("kind"),
        (F.floor(F.col("event_id") / 2) % 5).alias("review_id"), F.when(F.col("event_id") % 31 == 1, OWNER.upper()).otherwise("someone").alias("actor"),
    )


def timeline_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.owner_overrides(timeline_of(spark, sf_dir), OWNER)


def greedy_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.fitting_contents(fx.change_files(spark, sf_dir).where("not binary and status <> 'deleted'"), 20_000)


def scrutiny_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    places = ["nix/f{}.nix", "a{}/requirements/base.txt", "b{}/build.rs", "c{}/setup.py", "d{}/package.json", "e{}/.vscode/tasks.json", "vendor/f{}.js", "g{}/x.min.css", "src/h{}.py", "i{}/uv.lock"]
    path = F.element_at(F.array(*[F.concat(F.lit(x.split("{}")[0]), name, F.lit(x.split("{}")[1])) if "{}" in x else F.lit(x) for x in places]), (key % 10 + 1).cast("int"))
    files = table(spark, sf_dir, "supplier").select(
        path.alias("path"), F.when(key % 13 == 0, "deleted").otherwise("added").alias("status"), F.when(key % 7 == 0, "120000").otherwise("100644").alias("new_mode"), (key % 11 == 0).alias("gitlink"), (key * 37 % 2000).alias("longest_line")
    )
    return gate.scrutiny(files)


def url_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.lit("ththth.example.org"), F.lit("tionsh.example.net"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.bad_urls(F.col("url"), allowed), ",").alias("bad"))


def vendor_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = F.when(F.col("doc_id") % 3 == 0, "true").otherwise("false")
    body = F.concat(F.lit('{"flagged": '), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit(', "breakdown": [{"detector_type": "prompt_attack", "detected": '), detected, F.lit("}"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("]}"))
    return table(spark, sf_dir, "documents").select("doc_id", replies.lakera_reason(body).alias("reason"))


QUERIES = (
    scrutiny_reasons, url_findings, vendor_replies, panel_outcome, panel_summary_parse, honeypot_reduce, judge_unanimous, arbitration_route, canary_containment_join, scorecard, first_attempt_metrics, fn_fp_ids,
    infra_reason_filter, host_allowlist_anti, multiset_new_findings, row_number_anti, pip_logical_lines, magic_prefix_join, glob_exempt_join, gate_decide,
    severity_topk, newest_marker, timeline_override, greedy_contents,
)

PANEL = f"""
votes_cleaned AS (
  SELECT *, CASE WHEN reason = 'pass' OR reason = vendor || ':prompt_attack' OR starts_with(reason, vendor || '_unavailable:') THEN reason ELSE vendor || '_unavailable:bad-result' END AS said FROM panel_votes
), graded AS (
  SELECT *, CASE WHEN said = 'pass' THEN 'pass' WHEN said = vendor || ':prompt_attack' THEN 'flag' WHEN said IN (vendor || '_unavailable:HTTPError:429', vendor || '_unavailable:throttled') THEN 'quota' ELSE 'hard' END AS grade FROM votes_cleaned
), panel_sums AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE grade IN ('pass', 'flag')) AS INTEGER) AS verdicts, min_by(said, vendor_ord) FILTER (WHERE grade = 'flag') AS flag,
    min_by(said, vendor_ord) FILTER (WHERE grade = 'hard') AS hard, min_by(said, vendor_ord) FILTER (WHERE grade IN ('hard', 'quota')) AS short FROM graded GROUP BY doc_id
), panel AS (
  SELECT doc_id, CASE WHEN verdicts >= {FLOOR} THEN CASE WHEN flag IS NOT NULL THEN 'flagged' ELSE 'pass' END WHEN hard IS NOT NULL THEN 'unavailable' ELSE 'degraded-quota' END AS outcome,
    CASE WHEN verdicts >= {FLOOR} THEN coalesce(flag, 'pass') ELSE coalesce(hard, short) END AS reason, verdicts FROM panel_sums
)
"""
HONEYPOT = """
honeypot_sums AS (
  SELECT doc_id, min_by(scenario || ':' || signal, scenario_ord) FILTER (WHERE verdict = 'Honeypot_Triggered') AS hit, min_by(scenario || ':' || signal, scenario_ord) FILTER (WHERE verdict = 'Honeypot_Skipped') AS gap,
    count(*) FILTER (WHERE verdict = 'Honeypot_Skipped') AS gaps, count(*) AS total FROM honeypot_results GROUP BY doc_id
), honeypot AS (
  SELECT doc_id, hit IS NULL AND gap IS NULL AS ok,
    CASE WHEN hit IS NOT NULL THEN 'honeypot:' || hit || CASE WHEN gaps > 0 THEN '+skipped=' || gaps || '/' || total ELSE '' END
         WHEN gap IS NOT NULL THEN 'honeypot_unavailable:' || gap || '+skipped=' || gaps || '/' || total ELSE 'pass' END AS reason FROM honeypot_sums
)
"""
JUDGE = """
judge_sums AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE vote = 'benign') AS benign, min_by(judge, judge_ord) FILTER (WHERE vote = 'attack') AS attack,
    min_by('judge_unavailable:' || judge || ':' || signal, judge_ord) FILTER (WHERE vote = 'unavailable') AS outage FROM judge_votes GROUP BY doc_id
), judged AS (
  SELECT doc_id, n = 2 AND benign = n AS ok, CASE WHEN n = 2 AND benign = n THEN 'benign-unanimous' WHEN attack IS NOT NULL THEN 'attack:' || attack ELSE coalesce(outage, 'judge_unavailable:panel-incomplete') END AS reason FROM judge_sums
)
"""
ROUTE = """
route AS (
  SELECT p.doc_id, CASE WHEN outcome = 'unavailable' THEN p.reason WHEN NOT h.ok THEN 'honeypot:' || h.reason WHEN outcome <> 'pass' AND NOT j.ok THEN 'l2_arbitration:' || j.reason ELSE 'pass' END AS reason
  FROM panel p JOIN honeypot h ON p.doc_id = h.doc_id JOIN judged j ON p.doc_id = j.doc_id
)
"""
ALL_VOTES = f"WITH {fx.PANEL_VOTES}, {PANEL}, {fx.HONEYPOT_RESULTS}, {HONEYPOT}, {fx.JUDGE_VOTES}, {JUDGE}, {ROUTE}"
CARD = """
  SELECT count(*) FILTER (WHERE {p} = 'block' AND expected = 'block') AS tp, count(*) FILTER (WHERE {p} <> 'block' AND expected = 'block') AS fn,
    count(*) FILTER (WHERE {p} = 'block' AND expected <> 'block') AS fp, count(*) FILTER (WHERE {p} <> 'block' AND expected <> 'block') AS tn FROM settled
"""
RATE = "coalesce({a}::DOUBLE / nullif({b}, 0), 0)"
SENSITIVE = """
WITH {files}, paths AS (SELECT path FROM change_files UNION ALL SELECT old_path FROM change_files WHERE old_path IS NOT NULL AND old_path <> path)
SELECT path, reason, CASE WHEN (regexp_full_match(path, '\\.github/x.*\\.md') OR regexp_full_match(path, 'docs/d1.*/CLAUDE\\.md')) AND NOT starts_with(path, '.github/workflows/') THEN 'scrutiny' ELSE 'hit' END AS outcome
FROM (SELECT path, CASE WHEN starts_with(path, '.github/') THEN 'github' WHEN lower(split_part(path, '/', -1)) = 'claude.md' OR starts_with(path, '.codex/') THEN 'agent-instructions' END AS reason FROM paths) WHERE reason IS NOT NULL
"""
SQL = {
    "scrutiny_reasons": """WITH f AS (SELECT s_suppkey AS k, s_suppkey % 10 AS p, CAST(s_suppkey AS VARCHAR) AS n FROM supplier WHERE s_suppkey % 13 <> 0),
        g AS (SELECT k, p, ['nix/f' || n || '.nix', 'a' || n || '/requirements/base.txt', 'b' || n || '/build.rs', 'c' || n || '/setup.py', 'd' || n || '/package.json', 'e' || n || '/.vscode/tasks.json',
          'vendor/f' || n || '.js', 'g' || n || '/x.min.css', 'src/h' || n || '.py', 'i' || n || '/uv.lock'][p + 1] AS path FROM f)
        SELECT path, 0 AS ord, 'nix' AS reason FROM g WHERE p = 0 UNION ALL SELECT path, 1, 'lockfile' FROM g WHERE p IN (1, 9) UNION ALL SELECT path, 2, 'build-script' FROM g WHERE p = 2
        UNION ALL SELECT path, 3, 'install-script' FROM g WHERE p = 3 UNION ALL SELECT path, 4, 'package-manifest' FROM g WHERE p = 4 UNION ALL SELECT path, 5, 'dev-autorun' FROM g WHERE p = 5
        UNION ALL SELECT path, 6, 'minified-or-vendored' FROM g WHERE p IN (6, 7) UNION ALL SELECT path, 7, 'symlink' FROM g WHERE k % 7 = 0 UNION ALL SELECT path, 8, 'submodule' FROM g WHERE k % 11 = 0
        UNION ALL SELECT path, 9, 'long-line' FROM g WHERE k * 37 % 2000 > 500""",
    "url_findings": r"""SELECT page_id, CASE WHEN starts_with(url, 'https://') AND host IN ('ththth.example.org', 'tionsh.example.net') THEN '' ELSE split_part(url, ':', 1) || '://' || host END AS bad
        FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)""",
    "vendor_replies": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'lakera_unavailable:bad-response' WHEN doc_id % 3 <> 0 THEN 'pass' WHEN doc_id % 2 = 0 THEN 'lakera:prompt_attack' ELSE 'lakera_unavailable:bad-response' END AS reason FROM documents""",
    "panel_outcome": f"WITH {fx.PANEL_VOTES}, {PANEL} SELECT * FROM panel",
    "panel_summary_parse": f"WITH {fx.PANEL_VOTES}, {PANEL} SELECT doc_id, outcome || ' verdicts=' || verdicts || '/2 floor={FLOOR}' AS summary, CASE WHEN doc_id % 9 <> 0 THEN outcome END AS outcome FROM panel",
    "honeypot_reduce": f"WITH {fx.HONEYPOT_RESULTS}, {HONEYPOT} SELECT * FROM honeypot",
    "judge_unanimous": f"WITH {fx.JUDGE_VOTES}, {JUDGE} SELECT * FROM judged",
    "arbitration_route": f"{ALL_VOTES} SELECT * FROM route",
    "infra_reason_filter": f"""{ALL_VOTES} SELECT doc_id, reason, ends_with(split_part(split_part(reason, ':', 1), '+', 1), '_unavailable')
        OR (split_part(reason, ':', 1) IN ('honeypot', 'l2_arbitration') AND ends_with(split_part(split_part(reason, ':', 2), '+', 1), '_unavailable')) AS outage FROM route""",
    "canary_containment_join": """WITH canaries(canary_ord, label, token) AS (VALUES (0, 'C0', 'the and'), (1, 'C1', 'of the'), (2, 'C2', 'der die')),
        met AS (SELECT conv_id AS doc_id, label <> 'C' || (conv_id % 3) AS crossed, turn, canary_ord, label, role FROM conversations JOIN canaries ON contains(text, token))
        SELECT doc_id, (CASE WHEN crossed THEN 'canary_in_arg_crosstalk:' ELSE 'canary_in_arg:' END) || label || ':' || role AS signal FROM met
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY crossed, turn, canary_ord, role) = 1""",
    "scorecard": f"""WITH {fx.ATTEMPTS}, c AS ({CARD.format(p='predicted')}), r AS (SELECT *, {RATE.format(a='tp', b='tp + fp')} AS precision, {RATE.format(a='tp', b='tp + fn')} AS recall,
        {RATE.format(a='(tp + tn)', b='tp + tn + fp + fn')} AS accuracy, {RATE.format(a='fp', b='fp + tn')} AS fp_rate FROM c) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r""",
    "first_attempt_metrics": f"WITH {fx.ATTEMPTS}, c AS ({CARD.format(p='first_predicted')}) SELECT {RATE.format(a='tp', b='tp + fn')} AS first_recall, {RATE.format(a='fp', b='fp + tn')} AS first_fp_rate FROM c",
    "fn_fp_ids": f"""WITH {fx.ATTEMPTS}, wrong AS (SELECT 'fn' AS kind, id FROM settled WHERE expected = 'block' AND predicted <> 'block' UNION ALL SELECT 'fp', id FROM settled WHERE expected <> 'block' AND predicted = 'block'
        UNION ALL SELECT 'flaky', id FROM settled WHERE predicted = expected AND first_predicted <> expected) SELECT kind, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id DESC) AS ids FROM wrong GROUP BY kind""",
    "host_allowlist_anti": r"SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages) WHERE host NOT IN ('ththth.example.org', 'tionsh.example.net')",
    "multiset_new_findings": """WITH f AS (SELECT l_returnflag AS what, l_linestatus || CAST(l_quantity % 7 AS INTEGER) AS value, l_orderkey FROM lineitem)
        SELECT what, value, count(*) AS n FROM (SELECT what, value FROM f WHERE l_orderkey % 2 = 0 EXCEPT ALL SELECT what, value FROM f WHERE l_orderkey % 2 = 1) GROUP BY what, value""",
    "row_number_anti": f"""WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY path, version, line ORDER BY line_no) AS nth FROM lines)
        SELECT path, line_no, line FROM n h WHERE version = 0 AND NOT EXISTS (SELECT 1 FROM n b WHERE b.version = 1 AND b.path = h.path AND b.line = h.line AND b.nth = h.nth)""",
    "pip_logical_lines": rf"""WITH {LINES}, m AS (SELECT *, starts_with(line, '#') AS comment, ends_with(line, '\') AND NOT starts_with(line, '#') AS joins FROM lines),
        s AS (SELECT *, CASE WHEN coalesce(lag(joins) OVER (PARTITION BY path ORDER BY line_no), false) THEN 0 ELSE 1 END AS start FROM m),
        r AS (SELECT *, sum(start) OVER (PARTITION BY path ORDER BY line_no) AS run FROM s)
        SELECT path, min(line_no) AS line_no, string_agg(CASE WHEN joins THEN trim(line, '\') WHEN comment THEN ' ' || line ELSE line END, '' ORDER BY line_no) AS line FROM r GROUP BY path, run""",
    "magic_prefix_join": f"""WITH {fx.CHANGE_FILES}, k AS (SELECT path, CASE WHEN ord % 3 <> 1 THEN CASE WHEN ord % 22 = 0 THEN 'png' WHEN ord % 33 = 0 THEN 'gif' WHEN ord % 14 = 0 THEN 'script' ELSE 'none' END END AS kind,
          NOT ends_with(path, '.png') OR coalesce(ord % 3 <> 1 AND ord % 22 <> 0 AND ord % 33 <> 0 AND ord % 14 = 0, false) AS unknown FROM change_files WHERE binary_file AND status <> 'deleted')
        SELECT path, CASE WHEN unknown OR kind = 'gif' THEN 'text-binary' ELSE 'binary' END AS rule,
          CASE WHEN unknown THEN 'not a known binary type' WHEN kind IS NULL THEN 'content not fetched' WHEN kind = 'none' THEN 'unrecognised content type'
               WHEN kind = 'gif' THEN 'mismatch: content is gif, extension says png' ELSE 'content is png' END AS detail,
          NOT (unknown OR coalesce(kind = 'gif', false)) AS overridable FROM k""",
    "glob_exempt_join": SENSITIVE.replace("{files}", fx.CHANGE_FILES).replace("\\\\", "\\"),
    "gate_decide": f"""WITH {fx.CHANGE_FILES}, {fx.FINDINGS}, rules AS (SELECT DISTINCT change_id, 1 AS part, 'deterministic check: ' || CASE WHEN ord % 2 = 0 THEN 'binary' ELSE 'text-binary' END AS said, 0 AS ord FROM change_files WHERE binary_file AND ord % 5 = 0),
        passes AS (SELECT change_id, name, o, (change_id + o * 3) % 10 AS state, change_id * 17 % 101 - o AS suspicion FROM (SELECT DISTINCT change_id FROM change_files), (VALUES (0, 'intent'), (1, 'code'), (2, 'deps')) v(o, name)),
        tops AS (SELECT change_id, CAST(max(suspicion) FILTER (WHERE state > 1) AS INTEGER) AS suspicion, count(*) FILTER (WHERE state = 1) AS infra FROM passes GROUP BY change_id),
        firsts AS (SELECT change_id, category, severity, min(ord) AS ord FROM findings WHERE (category || ' ' || severity) IN ('malicious medium', 'malicious high', 'obscure medium', 'obscure high', 'security high') GROUP BY ALL),
        said AS (SELECT * FROM rules UNION ALL SELECT change_id, 2, 'reviewer did not complete: ' || name || ': cut-off', o FROM passes WHERE state = 0
          UNION ALL SELECT change_id, 3, 'suspicion ' || suspicion || ' >= threshold 70', 0 FROM tops WHERE suspicion >= 70
          UNION ALL SELECT change_id, 4, 'finding: ' || category || ' (' || severity || ')', ord FROM firsts)
        , ids AS (SELECT change_id FROM tops UNION SELECT change_id FROM said)
        SELECT i.change_id, count(s.said) > 0 OR coalesce(any_value(t.infra), 0) > 0 AS block, any_value(t.suspicion) AS suspicion, coalesce(string_agg(s.said, '; ' ORDER BY part, s.ord, s.said), '') AS reasons
        FROM ids i LEFT JOIN tops t ON t.change_id = i.change_id LEFT JOIN said s ON i.change_id = s.change_id GROUP BY i.change_id""",
    "severity_topk": f"""WITH {fx.FINDINGS} SELECT change_id, CAST(place AS INTEGER) AS place, ord, category, severity FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY list_position(['high', 'medium', 'low'], severity), ord) AS place FROM findings) WHERE place <= 40""",
    "newest_marker": "SELECT o_custkey % 50 AS change_id, max(o_orderkey) AS review_id, max_by(o_orderstatus || ':' || o_orderpriority, o_orderkey) AS marker FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1",
    "timeline_override": f"""WITH t AS (SELECT user_id % 60 AS change_id, event_id AS ord, CASE WHEN event_id % 37 = 0 THEN 'rewrite' WHEN event_id % 2 = 0 THEN 'reviewed' ELSE 'dismissed' END AS kind,
          event_id // 2 % 5 AS review_id, CASE WHEN event_id % 31 = 1 THEN '{OWNER.upper()}' ELSE 'someone' END AS actor FROM events),
        last AS (SELECT t.* FROM t JOIN (SELECT change_id, coalesce(max(ord) FILTER (WHERE kind = 'rewrite'), -1) AS since FROM t GROUP BY 1) s ON t.change_id = s.change_id AND t.ord > s.since),
        overs AS (SELECT DISTINCT d.change_id FROM last d JOIN last r ON d.change_id = r.change_id AND d.review_id = r.review_id AND r.kind = 'reviewed' AND d.kind = 'dismissed' AND d.ord > r.ord AND lower(d.actor) = lower('{OWNER}'))
        SELECT DISTINCT t.change_id, o.change_id IS NOT NULL AS overridden FROM t LEFT JOIN overs o ON t.change_id = o.change_id""",
    "greedy_contents": f"""WITH RECURSIVE {fx.CHANGE_FILES}, f AS (SELECT change_id, path, size, row_number() OVER (PARTITION BY change_id ORDER BY ord) AS i FROM change_files WHERE NOT binary_file AND status <> 'deleted'),
        w AS (SELECT change_id, path, i, size <= 20000 AS taken, 20000 - CASE WHEN size <= 20000 THEN size ELSE 0 END AS room FROM f WHERE i = 1
          UNION ALL SELECT f.change_id, f.path, f.i, f.size <= w.room, w.room - CASE WHEN f.size <= w.room THEN f.size ELSE 0 END FROM w JOIN f ON f.change_id = w.change_id AND f.i = w.i + 1)
        SELECT change_id, path, taken FROM w""",
}
