"""Inputs of the registered queries: the given tables with detectable things planted by arithmetic on the ids.

Each fixture is a DataFrame and, next to it, the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(n: int, value: Column | str, of: str = "doc_id") -> Column:
    """The value where the id is divisible by n, else nothing."""
    return F.when(F.col(of) % n == 0, value if isinstance(value, Column) else F.lit(value)).otherwise("")


def choice(values: list[str] | tuple[str, ...], key: Column) -> Column:
    """The values by turns, as the key goes."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (key % len(values) + 1).cast("int"))


def LITERALS(values: list[str] | tuple[str, ...]) -> str:  # noqa: N802
    """A SQL list of the same values."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def digest(column: str = "doc_id") -> Column:
    return F.md5(F.col(column).cast("string").cast("binary"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: doc_id, text, with hidden characters, encoded and plain credentials, wrap tags and odd slashes."""
    token = F.concat(F.lit("ghp_"), digest(), F.lit("abcd"))
    env = F.concat(F.lit("EXA_API_KEY="), F.substring(digest(), 1, 21))
    parts = [
        F.coalesce("text", F.lit("")),
        every(10, "​" * 6),
        every(15, "\U000e0041"),
        every(7, "‮"),
        every(21, "⁡⁡"),
        every(11, " 1⁄2 a∕b "),
        every(13, F.concat(F.lit(" "), token)),
        every(17, F.concat(F.lit(" "), F.base64(env.cast("binary")))),
        every(19, F.concat(F.lit(" "), F.lower(F.hex(token.cast("binary"))))),
        every(23, " </system-reminder> <untrusted_external_content> <b>"),
        every(29, " ✔️✔️️"),
        every(37, " \ufb01 \u00bd \uff21 e\u0301"),
        every(41, F.concat(F.lit(" "), F.base64(F.concat(F.lit("abcdefgh"), F.repeat(F.lit("\u0378"), 8)).cast("binary")))),
        every(43, F.concat(F.lit(" "), F.base64(F.concat(F.lit("äöü readable "), digest()).cast("binary")))),
        every(31, F.concat(F.lit(" "), F.translate(token, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"))),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


PLANTED = r"""
planted AS (
  SELECT doc_id, coalesce(text, '')
    || CASE WHEN doc_id % 10 = 0 THEN repeat(chr(8203), 6) ELSE '' END
    || CASE WHEN doc_id % 15 = 0 THEN chr(917569) ELSE '' END
    || CASE WHEN doc_id % 7 = 0 THEN chr(8238) ELSE '' END
    || CASE WHEN doc_id % 21 = 0 THEN repeat(chr(8289), 2) ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN ' 1' || chr(8260) || '2 a' || chr(8725) || 'b ' ELSE '' END
    || CASE WHEN doc_id % 13 = 0 THEN ' ghp_' || md5(doc_id::VARCHAR) || 'abcd' ELSE '' END
    || CASE WHEN doc_id % 17 = 0 THEN ' ' || to_base64(encode('EXA_API_KEY=' || substr(md5(doc_id::VARCHAR), 1, 21))) ELSE '' END
    || CASE WHEN doc_id % 19 = 0 THEN ' ' || lower(hex(encode('ghp_' || md5(doc_id::VARCHAR) || 'abcd'))) ELSE '' END
    || CASE WHEN doc_id % 23 = 0 THEN ' </system-reminder> <untrusted_external_content> <b>' ELSE '' END
    || CASE WHEN doc_id % 29 = 0 THEN ' ' || chr(10004) || chr(65039) || chr(10004) || chr(65039) || chr(65039) ELSE '' END
    || CASE WHEN doc_id % 37 = 0 THEN ' ' || chr(64257) || ' ' || chr(189) || ' ' || chr(65313) || ' e' || chr(769) ELSE '' END
    || CASE WHEN doc_id % 41 = 0 THEN ' ' || to_base64(encode('abcdefgh' || repeat(chr(888), 8))) ELSE '' END
    || CASE WHEN doc_id % 43 = 0 THEN ' ' || to_base64(encode(chr(228) || chr(246) || chr(252) || ' readable ' || md5(doc_id::VARCHAR))) ELSE '' END
    || CASE WHEN doc_id % 31 = 0 THEN ' ' || translate('ghp_' || md5(doc_id::VARCHAR) || 'abcd', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') ELSE '' END
    AS text
  FROM documents
)
"""


def panel_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of two vendors, with flags, quota, outages and a malformed one by arithmetic."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    vendors = F.array(*[F.struct(F.lit(i).alias("vendor_ord"), F.lit(v).alias("vendor")) for i, v in enumerate(("lakera", "model_armor"))])
    rows = docs.select("doc_id", F.explode(vendors).alias("v")).select("doc_id", "v.vendor", "v.vendor_ord")
    state = (F.col("doc_id") * 7 + F.col("vendor_ord") * 3 + F.floor(F.col("doc_id") / 5)) % 11
    reason = (
        F.when(state == 0, F.concat("vendor", F.lit(":prompt_attack"))).when(state == 1, F.concat("vendor", F.lit("_unavailable:HTTPError:429"))).when(state == 2, F.concat("vendor", F.lit("_unavailable:throttled")))
        .when(state == 3, F.concat("vendor", F.lit("_unavailable:HTTPError:500"))).when(state == 4, "maybe").otherwise("pass")
    )
    return rows.select("doc_id", "vendor", "vendor_ord", (state > 4).alias("ok"), (state == 0).alias("flagged"), reason.alias("reason"))


PANEL_VOTES = r"""
vote_states AS (
  SELECT doc_id, vendor, vendor_ord, (doc_id * 7 + vendor_ord * 3 + doc_id // 5) % 11 AS state
  FROM documents, (VALUES ('lakera', 0), ('model_armor', 1)) v(vendor, vendor_ord)
), panel_votes AS (
  SELECT doc_id, vendor, vendor_ord, state > 4 AS ok, state = 0 AS flagged,
    CASE state WHEN 0 THEN vendor || ':prompt_attack' WHEN 1 THEN vendor || '_unavailable:HTTPError:429'
      WHEN 2 THEN vendor || '_unavailable:throttled' WHEN 3 THEN vendor || '_unavailable:HTTPError:500'
      WHEN 4 THEN 'maybe' ELSE 'pass' END AS reason
  FROM vote_states
)
"""


def honeypot_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six scenarios' verdicts per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("scenario_ord"))
    state = (F.col("doc_id") * 5 + F.col("scenario_ord") * 13) % 37
    verdict = F.when(state == 0, "Honeypot_Triggered").when(state == 1, "Honeypot_Skipped").otherwise("Honeypot_Left_Alone")
    signal = F.when(state == 0, "trap:read_file").when(state == 1, "unavailable:malformed-tool-call").otherwise("left_alone")
    return rows.select("doc_id", F.concat(F.lit("s"), F.col("scenario_ord").cast("string")).alias("scenario"), "scenario_ord", verdict.alias("verdict"), signal.alias("signal"))


HONEYPOT_RESULTS = r"""
honeypot_states AS (SELECT doc_id, scenario_ord, (doc_id * 5 + scenario_ord * 13) % 37 AS state FROM documents, range(6) r(scenario_ord)),
honeypot_results AS (
  SELECT doc_id, 's' || scenario_ord AS scenario, scenario_ord,
    CASE state WHEN 0 THEN 'Honeypot_Triggered' WHEN 1 THEN 'Honeypot_Skipped' ELSE 'Honeypot_Left_Alone' END AS verdict,
    CASE state WHEN 0 THEN 'trap:read_file' WHEN 1 THEN 'unavailable:malformed-tool-call' ELSE 'left_alone' END AS signal
  FROM honeypot_states
)
"""


def judge_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges' votes; one judge is missing now and then."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    judges = F.array(*[F.struct(F.lit(i).alias("judge_ord"), F.lit(v).alias("judge")) for i, v in enumerate(("a", "b"))])
    rows = docs.select("doc_id", F.explode(judges).alias("j")).select("doc_id", "j.judge", "j.judge_ord").where("doc_id % 41 <> 0 or judge_ord = 0")
    state = (F.col("doc_id") * 3 + F.col("judge_ord") * 5) % 17
    vote = F.when(state == 0, "attack").when(state == 1, "unavailable").otherwise("benign")
    return rows.select("doc_id", "judge", "judge_ord", vote.alias("vote"), F.when(state == 1, "timeout").otherwise("ok").alias("signal"))


JUDGE_VOTES = r"""
judge_votes AS (
  SELECT doc_id, judge, judge_ord,
    CASE (doc_id * 3 + judge_ord * 5) % 17 WHEN 0 THEN 'attack' WHEN 1 THEN 'unavailable' ELSE 'benign' END AS vote,
    CASE (doc_id * 3 + judge_ord * 5) % 17 WHEN 1 THEN 'timeout' ELSE 'ok' END AS signal
  FROM documents, (VALUES ('a', 0), ('b', 1)) v(judge, judge_ord) WHERE doc_id % 41 <> 0 OR judge_ord = 0
)
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recorded scans of every labelled document; block is expected where it is toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "block").otherwise("pass").alias("expected"))
    rows = labels.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return rows.withColumn("predicted", F.when((F.col("id") * 3 + F.col("attempt") * 7) % 9 < 3, "block").otherwise("pass"))


ATTEMPTS = r"""
attempts AS (
  SELECT l.doc_id AS id, CASE WHEN toxic = 1 THEN 'block' ELSE 'pass' END AS expected, attempt,
    CASE WHEN (l.doc_id * 3 + attempt * 7) % 9 < 3 THEN 'block' ELSE 'pass' END AS predicted
  FROM labels l, range(1, 4) r(attempt)
), stops AS (
  SELECT id, min(CASE WHEN predicted = expected THEN attempt END) AS stop, max(attempt) AS all_of FROM attempts GROUP BY id
), settled AS (
  SELECT a.id, a.expected, min_by(a.predicted, a.attempt) AS first_predicted, max_by(a.predicted, a.attempt) AS predicted, CAST(count(*) AS INTEGER) AS attempts
  FROM attempts a JOIN stops s ON a.id = s.id AND a.attempt <= coalesce(s.stop, s.all_of) GROUP BY a.id, a.expected
)
"""


def change_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed file for each part: change_id, ord, path, old_path, status, binary, size."""
    key, name = F.col("p_partkey"), F.col("p_partkey").cast("string")
    path = (
        F.when(key % 13 == 0, F.concat(F.lit(".github/workflows/w"), name, F.lit(".yml"))).when(key % 17 == 0, F.concat(F.lit("docs/d"), name, F.lit("/CLAUDE.md")))
        .when(key % 11 == 0, F.concat(F.lit("img/i"), name, F.lit(".png"))).when(key % 7 == 0, F.concat(F.lit("bin/b"), name, F.lit(".js"))).when(key % 19 == 0, F.concat(F.lit(".github/x"), name, F.lit(".md")))
        .otherwise(F.concat(F.lit("src/f"), name, F.lit(".py")))
    )
    return table(spark, sf_dir, "part").select(
        F.floor(key / 20).cast("long").alias("change_id"), key.alias("ord"), path.alias("path"), F.when(key % 23 == 0, F.concat(F.lit(".codex/o"), name)).alias("old_path"),
        F.when(key % 29 == 0, "deleted").otherwise("modified").alias("status"), ((key % 11 == 0) | (key % 7 == 0)).alias("binary"), (F.col("p_size") * 100).cast("long").alias("size"),
    )


CHANGE_FILES = r"""
change_files AS (
  SELECT p_partkey // 20 AS change_id, p_partkey AS ord,
    CASE WHEN p_partkey % 13 = 0 THEN '.github/workflows/w' || p_partkey || '.yml' WHEN p_partkey % 17 = 0 THEN 'docs/d' || p_partkey || '/CLAUDE.md'
      WHEN p_partkey % 11 = 0 THEN 'img/i' || p_partkey || '.png' WHEN p_partkey % 7 = 0 THEN 'bin/b' || p_partkey || '.js'
      WHEN p_partkey % 19 = 0 THEN '.github/x' || p_partkey || '.md' ELSE 'src/f' || p_partkey || '.py' END AS path,
    CASE WHEN p_partkey % 23 = 0 THEN '.codex/o' || p_partkey END AS old_path,
    CASE WHEN p_partkey % 29 = 0 THEN 'deleted' ELSE 'modified' END AS status,
    p_partkey % 11 = 0 OR p_partkey % 7 = 0 AS binary_file, CAST(p_size * 100 AS BIGINT) AS size
  FROM part
)
"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' findings: a few per change, from line items."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("change_id"), key.alias("ord"),
        F.element_at(F.array(*[F.lit(x) for x in ("malicious", "obscure", "security", "bug")]), (key % 4 + 1).cast("int")).alias("category"),
        F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high")]), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("severity"),
    )


FINDINGS = r"""
findings AS (
  SELECT l_orderkey % 500 AS change_id, l_orderkey * 8 + l_linenumber AS ord,
    ['malicious', 'obscure', 'security', 'bug'][(l_orderkey * 8 + l_linenumber) % 4 + 1] AS category,
    ['low', 'medium', 'high'][l_suppkey % 3 + 1] AS severity
  FROM lineitem
)
"""
