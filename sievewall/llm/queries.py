"""The registered queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, licenses, lm_score, mixing, near_dedup, phrases, piece_bpe, secrets, topk, toxicity, url_filter, vector_codes
from .shared import held_out


def model_file() -> str:
    """The tokenizer file of the queries; a path, never a copy."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), model_file())
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learnt from the labels of all folds but the held-out one."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return toxicity.train(docs.select("doc_id", "text"), known)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.toxic_sentences(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("spans")).alias("spans"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = piece_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_file(), decoded="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "benchmark").select("text"), table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(model.digest).alias("codebooks_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf_dir, "documents"))
    joined = [F.array_join(x, ",").alias(x) for x in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_near_dedup, op4_toxicity, op5_secret_scan, op6_url_filter, op7_sentencepiece, op8_lm_score, op9_mixing, op10_topk, op11_vector_codes, op12_collocations, op13_license_scan)}


EXACT_DEDUP_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM plain
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT d.doc_id, d.source,
         len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / CASE WHEN l.quality >= 1 THEN 1.0::DOUBLE WHEN l.quality <= 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS k
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS share
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / share AS full_at,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))
           / (sum(share) OVER () - coalesce(sum(share) OVER w, 0)) AS level
  FROM sources
  WINDOW w AS (ORDER BY 3 * source_size / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN level > full_at THEN cap
              ELSE least(cap, share * max(CASE WHEN level <= full_at THEN level END) OVER ()) END AS target
  FROM levels
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets
), ordered AS (
  SELECT s.doc_id, s.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS until
  FROM sized s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND until - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""


TOPK_SQL = r"""
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ints q JOIN ints d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scores
)
SELECT * FROM ranked WHERE rank <= 10
"""


def vector_codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds spelt out: each is an assignment of all distinct parts (a), then moved entries (b)."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT part, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
    SELECT x.part, x.p, b.e, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS d
    FROM places x JOIN b{k} b ON x.p = b.p AND x.i = b.i GROUP BY x.part, x.p, b.e
  ) GROUP BY part, p
)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, CASE WHEN m.n IS NULL THEN b.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
  FROM b{k} b LEFT JOIN (
    SELECT x.p, a.e, x.i, CAST(sum(x.v * x.weight) AS BIGINT) AS s, CAST(sum(x.weight) AS BIGINT) AS n
    FROM places x JOIN a{k} a ON x.part = a.part AND x.p = a.p GROUP BY x.p, a.e, x.i
  ) m ON b.p = m.p AND b.e = m.e AND b.i = m.i
)""")
    return f"""
WITH ints AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v, len(embedding) // 4 AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * w + 1 : p * w + w] AS part FROM ints, range(4) r(p)
), places AS MATERIALIZED (
  SELECT part, p, weight, i, part[i + 1] AS v
  FROM (SELECT part, p, count(*) AS weight FROM parts GROUP BY part, p) d, range((SELECT max(w) FROM ints)) r(i)
), b0 AS MATERIALIZED (
  SELECT p, e, i, part[i + 1] AS v
  FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) f, range((SELECT max(w) FROM ints)) r(i)
  WHERE e < 256
), {", ".join(steps)}, coded AS (
  SELECT x.vec_id, x.label, string_agg(printf('%02x', a.e), '' ORDER BY x.p) AS code, CAST(sum(a.d) AS BIGINT) AS error
  FROM parts x JOIN a{rounds} a ON x.part = a.part AND x.p = a.p GROUP BY x.vec_id, x.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 4) r(m))
), counts AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 10
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 :], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, array_to_string(w[1 : 2], ' ') AS phrase FROM candidates WHERE m = 3
    UNION ALL SELECT lang, a, array_to_string(w[2 : 3], ' ') FROM candidates WHERE m = 3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN longer x ON x.lang = w.lang AND x.phrase = w.phrase
  WHERE x.a IS NULL OR 100 * x.a < 50 * w.a
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase,
       k.a, k.l, k.r, CAST(t.n AS BIGINT) AS n, CAST(k.score AS BIGINT) AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT_DEDUP_SQL, "op9_mixing": MIXING_SQL, "op10_topk": TOPK_SQL, "op11_vector_codes": vector_codes_sql(), "op12_collocations": COLLOCATIONS_SQL}
