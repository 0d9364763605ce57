"""Queries over planted documents: hidden Unicode, encodings, credentials, verdicts, windows, delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewall.functions import credentials, encodings, unicode
from sievewall.operators import verdicts, windows

from .fixtures import PLANTED, planted, table

# The SQL has patterns of its own, written out: hidden characters of prose and of source code by class, and encoded passages.
P = {
    "tag": r"[\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]", "bidi": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", "zw": r"[\x{200B}-\x{200D}\x{FEFF}]", "fmt": r"[\x{180E}\x{2060}-\x{2064}\x{206A}-\x{206F}]",
    "any": r"[\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200D}\x{FEFF}\x{180E}\x{2060}-\x{2064}\x{206A}-\x{206F}]",
}
C = {
    "tag": r"[\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}\x{FE00}-\x{FE0F}]", "bidi": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}\x{061C}]", "zw": r"[\x{200B}-\x{200D}\x{FEFF}]",
    "fmt": r"[\x{AD}\x{034F}\x{115F}\x{1160}\x{180B}-\x{180F}\x{2028}\x{2029}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{3164}\x{FFA0}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]",
}
SQL_BASE64, SQL_HEX = r"[A-Za-z0-9+/_-]{24,}={0,2}", "[0-9a-fA-F]{32,}"
RULE_SQL = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in credentials.RULES) + " END"


def count_sql(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def l0_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in unicode.hidden_counts(F.col("text")).items()])


def l0_code_profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = unicode.hidden_counts(F.col("text"), "code")
    return planted(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in counts.items()], (counts["stripped"] - unicode.exposed_selectors(F.col("text"))).alias("findable"))


def l0_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unicode.sanitized(planted(spark, sf_dir))
    return found.select("doc_id", F.length("clean").cast("int").alias("clean_length"), F.sha2("clean", 256).alias("clean_sha256"), "nfkc_changed")


def l0_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = unicode.hidden_counts(F.col("text"))["stripped"]
    return planted(spark, sf_dir).select("doc_id", unicode.is_anomalous(stripped, F.length("text")).alias("anomalous"))


def l0_verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).select(F.length("text").alias("n"), unicode.hidden_counts(F.col("text"))["stripped"].alias("stripped"))
    reason = F.when(unicode.is_anomalous(F.col("stripped"), F.col("n")), F.concat(F.lit("unicode_anomaly:stripped="), F.col("stripped").cast("string"))).otherwise("pass")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def decode_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).select("doc_id", F.posexplode(encodings.encoded_blobs(F.col("text"))).alias("ord", "b"))
    return rows.select("doc_id", "ord", "b.encoding", F.sha2("b.decoded", 256).alias("decoded_sha256"), "b.excerpt")


def decode_rescan_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = encodings.encoded_secret(encodings.encoded_blobs(F.col("text")))
    rows = planted(spark, sf_dir).select("doc_id", hit.alias("hit")).where("hit is not null")
    return rows.select("doc_id", F.concat(F.lit("encoded_secret:"), F.col("hit.encoding"), F.lit(":"), F.col("hit.rule")).alias("reason"))


def secret_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", F.explode(credentials.rule_hits(F.col("text"))).alias("h")).select("doc_id", "h.ord", "h.rule")


def verdict_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.screened(planted(spark, sf_dir)).select("doc_id", F.coalesce("reason", F.lit("pass")).alias("reason"))


def audit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.audit_rows(verdicts.screened(planted(spark, sf_dir)))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", verdicts.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def wrap_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", F.sha2(verdicts.without_wrap_tags(F.col("text")), 256).alias("body_sha256"))


def bucket_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.floor(F.col("value") * 100).cast("long") - 500
    return table(spark, sf_dir, "events").select("event_id", verdicts.time_bucket(raw).alias("bucket"))


def windows_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.text_windows(table(spark, sf_dir, "documents"), 1000, 100, 20)
    return found.select("doc_id", "n_windows", F.col("ord").cast("int").alias("ord"), F.sha2("window", 256).alias("window_sha256"))


def window_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.text_windows(planted(spark, sf_dir), 1000, 100)
    judged = cut.withColumn("reason", F.coalesce(F.concat(F.lit("secret_shape:"), credentials.first_rule(F.col("window"))), F.lit("pass")))
    return windows.first_failure(judged)


QUERIES = (
    l0_counts, l0_code_profile_counts, l0_strip, l0_anomaly, l0_verdict_reasons, decode_blobs, decode_rescan_reason, secret_rule_hits, verdict_first_reason,
    audit_projection, token_estimate, wrap_encode, bucket_ms, windows_explode, window_first_failure,
)

COUNTS = "CAST({t} AS INTEGER) AS tag_hits, CAST({b} AS INTEGER) AS bidi_hits, CAST({z} AS INTEGER) AS zw_hits, CAST({f} AS INTEGER) AS fmt_hits, CAST({t} + {b} + {z} + {f} AS INTEGER) AS stripped"


def counts_sql(own: dict[str, str]) -> str:
    return COUNTS.format(t=count_sql(own["tag"]), b=count_sql(own["bidi"]), z=count_sql(own["zw"]), f=count_sql(own["fmt"]))


ANOMALOUS = f"(length(text) > 0 AND {count_sql(P['any'])} >= 3 AND {count_sql(P['any'])} / length(text) > 0.001)"
BARE = f"regexp_replace(text, '{P['any']}', '', 'g')"
# DuckDB composes; the compatibility forms are those that the fixture plants.
CLEAN = f"translate(nfc_normalize(replace(replace(translate({BARE}, chr(65313), 'A'), chr(64257), 'fi'), chr(189), '1' || chr(8260) || '2')), chr(8260) || chr(8725), '//')"
ODD = r"[\p{Cc}\p{Cf}\p{Co}\p{Zs}\p{Zl}\p{Zp}\x{0378}]"


def text_of(raw: str) -> str:
    """Bytes as text, with the length and printability rules."""
    t = f"try(decode({raw}))"
    return f"CASE WHEN octet_length({raw}) >= 12 AND length({t}) - ({count_sql(ODD, t)} - {count_sql('[ \\t\\n\\r]', t)}) >= length({t}) * 0.9 THEN {t} END"


BLOBS = f"""
cleaned AS (SELECT doc_id, text, {CLEAN} AS clean FROM planted),
tokens AS (
  SELECT doc_id, 1 AS kind, unnest(regexp_extract_all(@T, '{SQL_BASE64}')) AS token, unnest(range(len(regexp_extract_all(@T, '{SQL_BASE64}')))) AS i FROM cleaned WHERE length(@T) >= 16
  UNION ALL
  SELECT doc_id, 2, unnest(regexp_extract_all(@T, '{SQL_HEX}')), unnest(range(len(regexp_extract_all(@T, '{SQL_HEX}')))) FROM cleaned WHERE length(@T) >= 16
), raw AS (
  SELECT doc_id, kind, i, token,
    CASE WHEN kind = 1 AND length(rtrim(token, '=')) % 4 <> 1 THEN try(from_base64(translate(rtrim(token, '='), '-_', '+/') || repeat('=', CAST((4 - length(rtrim(token, '=')) % 4) % 4 AS INTEGER))))
         WHEN kind = 2 AND length(token) % 2 = 0 THEN unhex(token) END AS raw
  FROM tokens
), blobs AS (
  SELECT doc_id, kind, i, CASE kind WHEN 1 THEN 'base64' ELSE 'hex' END AS encoding, {text_of('raw')} AS decoded, substr(token, 1, 40) AS excerpt FROM raw
  UNION ALL
  SELECT doc_id, 3, 0, 'rot13', translate(@T, '{encodings.LETTERS}', '{encodings.ROTATED}'), substr(@T, 1, 40) FROM cleaned WHERE length(@T) >= 16
), kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, i) - 1 AS ord FROM blobs WHERE decoded IS NOT NULL)
"""
ENCODED = f"first_encoded AS (SELECT doc_id, min_by('encoded_secret:' || encoding || ':' || rule, ord) AS reason FROM (SELECT *, {RULE_SQL('decoded')} AS rule FROM kept) WHERE rule IS NOT NULL GROUP BY doc_id)"
REASONS = f"""
reasons AS (
  SELECT c.doc_id, c.text, c.clean,
    CASE WHEN {ANOMALOUS} THEN 'unicode_anomaly:stripped=' || {count_sql(P['any'])} || '/' || length(text) END AS unicode_reason,
    e.reason AS encoded_reason, 'secret_shape:' || ({RULE_SQL('c.clean')}) AS secret_reason,
    (SELECT count(*) FROM kept k WHERE k.doc_id = c.doc_id) AS n_blobs,
    (SELECT string_agg(DISTINCT encoding, ',' ORDER BY encoding) FROM kept k WHERE k.doc_id = c.doc_id) AS encodings
  FROM cleaned c LEFT JOIN first_encoded e ON c.doc_id = e.doc_id
)
"""
SQL = {
    "l0_counts": f"WITH {PLANTED} SELECT doc_id, {counts_sql(P)} FROM planted",
    "l0_code_profile_counts": f"""WITH {PLANTED} SELECT * EXCLUDE t, stripped - len(regexp_extract_all(t, '[#*0-9\\x{{2600}}-\\x{{27BF}}][\\x{{FE0E}}\\x{{FE0F}}](?:[^\\x{{FE00}}-\\x{{FE0F}}]|$)')) AS findable FROM (SELECT doc_id, text AS t, {counts_sql(C)} FROM planted)""",
    "l0_strip": f"""WITH {PLANTED} SELECT doc_id, CAST(length(clean) AS INTEGER) AS clean_length, sha256(clean) AS clean_sha256, clean <> bare AS nfkc_changed
        FROM (SELECT doc_id, {CLEAN} AS clean, regexp_replace(text, '{P['any']}', '', 'g') AS bare FROM planted)""",
    "l0_anomaly": f"WITH {PLANTED} SELECT doc_id, {ANOMALOUS} AS anomalous FROM planted",
    "l0_verdict_reasons": f"""WITH {PLANTED} SELECT CASE WHEN {ANOMALOUS} THEN 'unicode_anomaly:stripped=' || {count_sql(P['any'])} ELSE 'pass' END AS reason, count(*) AS n FROM planted GROUP BY 1""",
    "decode_blobs": f"WITH {PLANTED}, {BLOBS.replace('@T', 'text')} SELECT doc_id, CAST(ord AS INTEGER) AS ord, encoding, sha256(decoded) AS decoded_sha256, excerpt FROM kept",
    "decode_rescan_reason": f"WITH {PLANTED}, {BLOBS.replace('@T', 'text')}, {ENCODED} SELECT * FROM first_encoded",
    "secret_rule_hits": f"WITH {PLANTED} " + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{n}' AS rule FROM planted WHERE regexp_matches(text, '{p}')" for i, (n, p) in enumerate(credentials.RULES)),
    "verdict_first_reason": f"WITH {PLANTED}, {BLOBS.replace('@T', 'clean')}, {ENCODED}, {REASONS} SELECT doc_id, coalesce(unicode_reason, encoded_reason, secret_reason, 'pass') AS reason FROM reasons",
    "audit_projection": f"""WITH {PLANTED}, {BLOBS.replace('@T', 'clean')}, {ENCODED}, {REASONS}
        SELECT doc_id, coalesce(unicode_reason, encoded_reason, secret_reason) IS NULL AS ok, coalesce(unicode_reason, encoded_reason, secret_reason, 'pass') AS reason,
          CAST(length(text) AS INTEGER) AS raw_length, CAST({count_sql(P['any'])} AS INTEGER) AS stripped, CAST(length(clean) AS INTEGER) AS clean_length,
          clean <> regexp_replace(text, '{P['any']}', '', 'g') AS nfkc_changed, CAST(n_blobs AS INTEGER) AS blobs,
          CASE WHEN unicode_reason IS NOT NULL THEN '{{"unicode_sanitize":"fail"}}'
               ELSE '{{"unicode_sanitize":"pass","decode":"blobs=' || n_blobs || ' encodings=' || coalesce(encodings, '') || '"'
                 || CASE WHEN encoded_reason IS NULL THEN ',"secret_shapes":"' || coalesce('fail:' || split_part(secret_reason, ':', 2), 'pass') || '"' ELSE '' END || '}}' END AS layers
        FROM reasons""",
    "token_estimate": r"SELECT doc_id, CAST(ceil(length(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) / 4) AS BIGINT) AS tokens FROM documents",
    "wrap_encode": rf"WITH {PLANTED} SELECT doc_id, sha256(regexp_replace(text, '(?i)<(\s*/?\s*(?:untrusted_external_content|system-reminder)\b)', '&lt;\1', 'g')) AS body_sha256 FROM planted",
    "bucket_ms": "SELECT event_id, CASE WHEN raw <= 0 THEN 5000 ELSE (raw + 4999) // 5000 * 5000 END AS bucket FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) - 500 AS raw FROM events)",
    "windows_explode": """WITH c AS (SELECT doc_id, coalesce(text, '') AS t, CAST(CASE WHEN length(coalesce(text, '')) <= 1000 THEN 1 ELSE 1 + ceil((length(text) - 1000) / 900) END AS INTEGER) AS n_windows FROM documents)
        SELECT doc_id, n_windows, CAST(i AS INTEGER) AS ord, sha256(substr(t, CAST(i * 900 + 1 AS BIGINT), 1000)) AS window_sha256 FROM c, LATERAL (SELECT unnest(range(n_windows)) AS i) WHERE n_windows <= 20
        UNION ALL SELECT doc_id, n_windows, NULL, NULL FROM c WHERE n_windows > 20""",
    "window_first_failure": f"""WITH {PLANTED}, c AS (SELECT doc_id, text AS t, CAST(CASE WHEN length(text) <= 1000 THEN 1 ELSE 1 + ceil((length(text) - 1000) / 900) END AS INTEGER) AS n FROM planted),
        w AS (SELECT doc_id, i, substr(t, CAST(i * 900 + 1 AS BIGINT), 1000) AS part FROM c, LATERAL (SELECT unnest(range(n)) AS i)), r AS (SELECT doc_id, i, {RULE_SQL('part')} AS rule FROM w)
        SELECT doc_id, coalesce(min_by('secret_shape:' || rule, i) FILTER (WHERE rule IS NOT NULL), 'pass') AS reason FROM r GROUP BY doc_id""",
}
