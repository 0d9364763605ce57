"""Queries over keyed state and over diffs built from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewall.operators import gate, limits
from sievewall.sources import diffs

from .fixtures import table


def account() -> Column:
    return F.concat("event_type", F.lit("-"), (F.col("user_id") % 40).cast("string"))


def limiter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor and account per event type and some users: mostly attempts, with refusals and successes between."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 50 == 0, "throttled").when(F.col("event_id") % 9 == 0, "success").otherwise("acquire")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return events.select(
        account().alias("vendor"), F.col("event_id").alias("ord"), seconds.alias("ts"), kind.alias("kind"), (seconds - F.col("event_id") % 7).alias("started_at"),
        F.when(F.col("event_id") % 100 == 0, "service").otherwise("quota").alias("cause"), F.when(F.col("event_id") % 150 == 0, 20.0).alias("retry_after"),
    )


def limiter_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.limiter_decisions(limiter_events(spark, sf_dir), limits.LimiterConfig(interval=600.0, burst=5.0, backoff=300.0, longest=3600.0))


def budget_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations of all events, an odd amount now and then; every seventh event gives back what came just before."""
    events = table(spark, sf_dir, "events").select(account().alias("vendor"), F.col("event_id").alias("ord"), "ts")
    before = F.lag("ord").over(Window.partitionBy("vendor").orderBy("ts", "ord"))
    release = F.col("ord") % 7 == 0
    return events.select("vendor", "ord", "ts", F.when(release, "release").otherwise("reserve").alias("kind"), F.when(release, before).otherwise(F.col("ord")).cast("string").alias("reservation"), F.when(F.col("ord") % 83 == 0, -1).otherwise(F.col("ord") % 97).alias("amount"))


def budget_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.budget_decisions(budget_events(spark, sf_dir), 400)


def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of ten shapes: plain ones, quoted and blank-holding paths, notes, marks that look like headers, moves, links, and what must be refused."""
    key = F.col("p_partkey").cast("string")

    def filled(shape: str) -> Column:
        return F.replace(F.replace(F.lit(shape), F.lit("@K"), key), F.lit("@N"), F.col("p_name"))

    shapes = F.array(*[filled(x) for x in DIFFS])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("change_id"), F.element_at(shapes, (F.col("p_partkey") % len(DIFFS) + 1).cast("int")).alias("diff"))


DIFFS = (
    "diff --git a/src/@K.py b/src/@K.py\nindex 1..2 100644\n--- a/src/@K.py\n+++ b/src/@K.py\n@@ -3,2 +3,3 @@ def f\n keep\n-old\n+new @N\n+x = @K\n",
    "diff --git \"a/t\\303\\244 @K.md\" \"b/t\\303\\244 @K.md\"\nnew file mode 100644\nindex 0..2\n--- /dev/null\n+++ \"b/t\\303\\244 @K.md\"\n@@ -0,0 +1,2 @@\n+@N\n+\n\\ No newline at end of file\n",
    "diff --git a/q@K.sql b/q@K.sql\nindex 1..2 100644\n--- a/q@K.sql\n+++ b/q@K.sql\n@@ -1,2 +1,3 @@\n--- gone\n+++ @N\n+@@ -1 +1 @@\n same\n@@ -9 +10,2 @@\n line\n+diff --git @K\n",
    "diff --git a/o p @K b/n@K\nsimilarity index 90%\nrename from o p @K\nrename to n@K\nindex 1..2 100644\n--- a/o p @K\t\n+++ b/n@K\n@@ -1 +1 @@\n-a\n+@N\n",
    "diff --git a/sub@K b/sub@K\nindex 1..2 160000\n--- a/sub@K\n+++ b/sub@K\n@@ -1 +1 @@\n-Subproject commit 1\n+Subproject commit @K\ndiff --git a/i@K.png b/i@K.png\nindex 1..2 100644\nBinary files a/i@K.png and b/i@K.png differ\n",
    "diff --git a/cut@K b/cut@K\n--- a/cut@K\n+++ b/cut@K\n@@ -1,2 +1,3 @@\n keep\n+@N\n",
    "diff --git \"a/bad\\377@K\" \"b/bad\\377@K\"\n--- \"a/bad\\377@K\"\n+++ \"b/bad\\377@K\"\n@@ -1 +1 @@\n-a\n+b\n",
    "diff --git a/odd@K b/odd@K\nnew file mode 100644\nsurprise @N\n",
    "+++ b/none@K\n@@ -0,0 +1 @@\n+@N\n",
    "diff --git a/d@K b/d@K\ndeleted file mode 100644\nindex 1..0\n--- a/d@K\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-@N\n-x\n",
)


def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines of all diffs, and the error of those that do not parse, from one reading of them."""
    parsed = diffs.parsed_diffs(diff_texts(spark, sf_dir))
    lines = F.flatten(F.transform("files", lambda f: F.transform(f["added"], lambda a: F.struct(f["path"].alias("path"), a["line_no"].alias("line_no"), a["text"].alias("text")))))
    failed = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line_no"), F.col("error").alias("text")))
    return parsed.select("change_id", F.explode(F.when(F.col("error").isNull(), lines).otherwise(failed)).alias("l")).select("change_id", "l.*")


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = diffs.changed_files(diffs.parsed_diffs(diff_texts(spark, sf_dir)))
    return files.select("change_id", "ord", "path", "old_path", "status", "binary", "old_mode", "new_mode", "gitlink", F.array_join("removed", "|").alias("removed"), F.size("body").alias("n_body"))


def hidden_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as added lines, some with hidden or control characters at their end, and files whose paths have some."""
    docs = table(spark, sf_dir, "documents")
    end = F.when(F.col("doc_id") % 6 == 0, "\u200b\u00ad\u200b").when(F.col("doc_id") % 10 == 0, "\x1b[0m").when(F.col("doc_id") % 9 == 0, "\r").when(F.col("doc_id") % 14 == 0, "\U000e0041\ue000").otherwise("")
    lines = docs.select(F.concat(F.lit("p"), (F.col("doc_id") % 10).cast("string")).alias("path"), F.col("doc_id").alias("line_no"), F.concat(F.translate(F.coalesce("text", F.lit("")), "\n\r", "  "), end).alias("text"))
    key = F.col("p_partkey")
    odd = F.when(key % 31 == 0, "\u200b").when(key % 37 == 0, "\t").when(key % 41 == 0, "\x85\u202e").otherwise("")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), key.cast("string"), odd).alias("path"), F.when(key % 62 == 0, "deleted").otherwise("added").alias("status"))
    return gate.hidden_hits(files, lines)


QUERIES = (limiter_decisions, budget_month, diff_parse, diff_files, hidden_added_lines)

LITERAL = lambda text: "'" + text.replace("'", "''") + "'"
TEXTS = f"diffs AS (SELECT p_partkey AS change_id, p_partkey % {len(DIFFS)} AS shape, replace(replace([{', '.join(LITERAL(x) for x in DIFFS)}][p_partkey % {len(DIFFS)} + 1], '@K', CAST(p_partkey AS VARCHAR)), '@N', p_name) AS diff FROM part)"
# Added lines of the good shapes, read from the text; the refused shapes by what is wrong with them.
LINES = """
l AS (SELECT change_id, unnest(range(len(string_split(diff, chr(10))))) AS pos, unnest(string_split(diff, chr(10))) AS line FROM diffs WHERE shape NOT IN (5, 6, 7, 8)),
h AS (SELECT *, sum(CASE WHEN starts_with(line, '@@') OR starts_with(line, 'diff --git') THEN 1 ELSE 0 END) OVER (PARTITION BY change_id ORDER BY pos) AS hunk, sum(CASE WHEN starts_with(line, 'diff --git') THEN 1 ELSE 0 END) OVER (PARTITION BY change_id ORDER BY pos) AS file FROM l),
n AS (SELECT *, first_value(line) OVER (PARTITION BY change_id, hunk ORDER BY pos) AS head, sum(CASE WHEN starts_with(line, '+') OR starts_with(line, ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY change_id, hunk ORDER BY pos) AS seen FROM h),
b AS (SELECT *, starts_with(head, '@@') AND pos > min(pos) OVER (PARTITION BY change_id, hunk) AS inside FROM n),
paths AS (SELECT change_id, file, max(CASE WHEN NOT inside AND starts_with(line, '+++ ') THEN replace(replace(rtrim(line, '"'), '+++ b/', ''), '+++ "b/t\\303\\244 ', 'tä ') END) AS path FROM b GROUP BY change_id, file)
"""
SQL = {
    "limiter_decisions": """WITH RECURSIVE e AS (SELECT event_type || '-' || (user_id % 40) AS vendor, event_id AS ord, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 50 = 0 THEN 'throttled' WHEN event_id % 9 = 0 THEN 'success' ELSE 'acquire' END AS kind,
          epoch_us(ts) / 1e6 - event_id % 7 AS started, CASE WHEN event_id % 100 = 0 THEN 'service' ELSE 'quota' END AS cause, CASE WHEN event_id % 150 = 0 THEN 20.0::DOUBLE END AS retry,
          row_number() OVER (PARTITION BY event_type || '-' || (user_id % 40) ORDER BY ts, event_id) AS i FROM events),
        w AS (SELECT DISTINCT vendor, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS decision, 0.0::DOUBLE AS wait, 5.0::DOUBLE AS tokens, 0.0::DOUBLE AS updated, 0.0::DOUBLE AS until, CAST(0 AS INTEGER) AS failures, CAST(NULL AS VARCHAR) AS because, 0.0::DOUBLE AS tripped FROM e
          UNION ALL
          SELECT vendor, i, ord,
            CASE WHEN kind <> 'acquire' THEN 'recorded' WHEN t < until THEN CASE WHEN because = 'service' THEN 'service_unavailable' ELSE 'throttled' END WHEN filled >= 1 - 1e-9 THEN 'allowed' ELSE 'throttled' END,
            CASE WHEN kind <> 'acquire' THEN 0 WHEN t < until THEN until - t WHEN filled >= 1 - 1e-9 THEN 0 ELSE (1 - filled) * 600 END,
            CASE kind WHEN 'acquire' THEN CASE WHEN t >= until AND filled >= 1 - 1e-9 THEN filled - 1 ELSE filled END WHEN 'throttled' THEN least(tokens, 1) ELSE tokens END,
            CASE WHEN kind = 'acquire' THEN t ELSE updated END,
            CASE WHEN kind = 'throttled' THEN greatest(until, t + least(greatest(coalesce(retry, 300 * pow(2, least(failures, 32))), 0), 3600)) WHEN kind = 'success' AND started >= tripped THEN 0 ELSE until END,
            CAST(CASE WHEN kind = 'throttled' THEN failures + 1 WHEN kind = 'success' AND started >= tripped THEN 0 ELSE failures END AS INTEGER),
            CASE WHEN kind = 'throttled' THEN CASE WHEN t < until AND because = 'service' THEN because ELSE cause END WHEN kind = 'success' AND started >= tripped THEN NULL ELSE because END,
            CASE WHEN kind = 'throttled' THEN t WHEN kind = 'success' AND started >= tripped THEN 0 ELSE tripped END
          FROM (SELECT w.* EXCLUDE (i, ord, decision, wait), e.* EXCLUDE (vendor), least(5, w.tokens + greatest(0, e.t - greatest(w.updated, w.until)) / 600) AS filled FROM w JOIN e ON e.vendor = w.vendor AND e.i = w.i + 1))
        SELECT vendor, ord, decision, wait FROM w WHERE i > 0""",
    "budget_month": """WITH RECURSIVE e AS (SELECT event_type || '-' || (user_id % 40) AS vendor, event_id AS ord, strftime(ts, '%Y-%m') AS month, event_id % 7 = 0 AS release, CASE WHEN event_id % 83 = 0 THEN -1 ELSE event_id % 97 END AS amount,
          row_number() OVER (PARTITION BY event_type || '-' || (user_id % 40) ORDER BY ts, event_id) AS i FROM events),
        w AS (SELECT DISTINCT vendor, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS decision, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS last, '' AS month FROM e
          UNION ALL
          SELECT vendor, i, ord, decision,
            CAST(CASE decision WHEN 'released' THEN greatest(0, used - last) WHEN 'allowed' THEN left_over + amount WHEN 'throttled' THEN left_over ELSE used END AS BIGINT),
            CASE WHEN decision = 'allowed' THEN amount END, CASE WHEN decision IN ('allowed', 'throttled') THEN greatest(month, new_month) ELSE month END
          FROM (SELECT *, CASE WHEN release THEN CASE WHEN last IS NOT NULL THEN 'released' ELSE 'ignored' END WHEN amount < 0 THEN 'error' WHEN left_over + amount <= 400 THEN 'allowed' ELSE 'throttled' END AS decision
            FROM (SELECT w.vendor, e.i, e.ord, w.used, w.last, w.month, e.month AS new_month, e.release, e.amount, CASE WHEN e.month > w.month THEN 0 ELSE w.used END AS left_over FROM w JOIN e ON e.vendor = w.vendor AND e.i = w.i + 1)))
        SELECT vendor, ord, decision, decision = 'allowed' AS granted, used FROM w WHERE i > 0""",
    "diff_parse": f"""WITH {TEXTS}, {LINES} SELECT b.change_id, path, CAST(CAST(regexp_extract(head, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)', 1) AS BIGINT) + seen - 1 AS BIGINT) AS line_no, substr(line, 2) AS text FROM b JOIN paths p ON b.change_id = p.change_id AND b.file = p.file WHERE inside AND starts_with(line, '+')
        UNION ALL SELECT change_id, NULL, NULL, CASE shape WHEN 5 THEN 'truncated hunk' WHEN 6 THEN 'bad file header' WHEN 7 THEN 'unexpected line outside a hunk' ELSE 'content before the first header' END FROM diffs WHERE shape IN (5, 6, 7, 8)""",
    "diff_files": """WITH k AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS n, p_name, p_partkey % 10 AS s FROM part)
        SELECT k AS change_id, CAST(0 AS INTEGER) AS ord, ['src/' || n || '.py', 'tä ' || n || '.md', 'q' || n || '.sql', 'n' || n, 'sub' || n, NULL, NULL, NULL, NULL, 'd' || n][s + 1] AS path, CASE WHEN s = 3 THEN 'o p ' || n END AS old_path,
          ['modified', 'added', 'modified', 'renamed', 'modified', NULL, NULL, NULL, NULL, 'deleted'][s + 1] AS status, false AS "binary", CASE WHEN s = 9 THEN '100644' END AS old_mode, CASE WHEN s = 1 THEN '100644' END AS new_mode, s = 4 AS gitlink,
          ['old', '', '-- gone', 'a', 'Subproject commit 1', NULL, NULL, NULL, NULL, p_name || '|x'][s + 1] AS removed, CAST([4, 3, 6, 2, 2, NULL, NULL, NULL, NULL, 2][s + 1] AS INTEGER) AS n_body FROM k WHERE s NOT IN (5, 6, 7, 8)
        UNION ALL SELECT k, 1, 'i' || n || '.png', NULL, 'modified', true, NULL, NULL, false, '', 0 FROM k WHERE s = 4""",
    "hidden_added_lines": r"""WITH lines AS (SELECT 'p' || (doc_id % 10) AS path, doc_id AS line_no, translate(coalesce(text, ''), chr(10) || chr(13), '  ')
            || CASE WHEN doc_id % 6 = 0 THEN chr(8203) || chr(173) || chr(8203) WHEN doc_id % 10 = 0 THEN chr(27) || '[0m' WHEN doc_id % 9 = 0 THEN chr(13) WHEN doc_id % 14 = 0 THEN chr(917569) || chr(57344) ELSE '' END AS text FROM documents),
        files AS (SELECT 'f' || p_partkey || CASE WHEN p_partkey % 31 = 0 THEN chr(8203) WHEN p_partkey % 37 = 0 THEN chr(9) WHEN p_partkey % 41 = 0 THEN chr(133) || chr(8238) ELSE '' END AS path FROM part WHERE p_partkey % 62 <> 0),
        found AS (SELECT path, line_no, 'line ' || line_no || ': ' AS place, regexp_extract_all(regexp_replace(text, '\r$', ''), '[\x{AD}\x{061C}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{FE00}-\x{FE0F}\x{E000}-\x{F8FF}\x{E0000}-\x{E01EF}\x00-\x08\x0B\x0D-\x1F\x7F-\x9F]') AS odd FROM lines
          UNION ALL SELECT path, NULL, 'in the file path: ', regexp_extract_all(path, '[\x{200B}-\x{200F}\x{2028}-\x{202E}\x00-\x1F\x7F-\x9F]') FROM files)
        SELECT path, line_no, place || list_aggregate(list_transform(list_slice(list_sort(list_distinct(list_transform(odd, lambda c: unicode(c)))), 1, 8), lambda u: printf('U+%04X', u)), 'string_agg', ', ') AS detail FROM found WHERE len(odd) > 0""",
}
