"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontaminate, language_model, line_dedup, mixing, near_dedup, packing, quality, resample, sharding, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(_table(spark, sf_dir, "conversations"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(_table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(_table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_chat_format": op3_chat_format,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_language_model": op9_language_model,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_packing": op12_packing,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
OP3_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 17) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

OP4_SQL = """
WITH split AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\n]*?(?:[.,;:!?][ \\t]+|\\n)|[^\\n]+') AS us FROM documents),
p AS (SELECT doc_id, generate_subscripts(us, 1) AS i, unnest(us) AS piece FROM split),
w AS (
  SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(piece) AS s,
    regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM p),
u AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
    row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, i) > 1 AS again FROM w WHERE len(w) > 0),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) AS z, count(*) AS units, min(s) AS s, max(s + strlen(piece)) AS e
  FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM u WHERE again)
  GROUP BY doc_id, island HAVING sum(len(w)) >= 40),
gone AS (
  SELECT doc_id, sum(units) AS units,
    string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s) AS bytes FROM runs GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, coalesce(string_agg(piece, '' ORDER BY i) FILTER (a IS NULL), '') AS kept,
    coalesce(sum(length(piece)) FILTER (a IS NOT NULL), 0) AS chars
  FROM p LEFT JOIN runs ON p.doc_id = runs.doc_id AND i BETWEEN a AND z GROUP BY p.doc_id)
SELECT doc_id, CAST(coalesce(units, 0) AS BIGINT) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS removed_chars, coalesce(bytes, '') AS removed_bytes,
  length(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) AS kept_chars, sha256(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY CAST(list_inner_product(a.q, b.q) AS BIGINT) DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
WHERE rank <= 10
"""

OP13_SQL = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
f AS (
  SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS d) WHERE len(w) >= d) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE d = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE d > 1 AND a >= 100),
part AS (SELECT lang, phrase, a, array_to_string(s[1:k], ' ') AS x, array_to_string(s[k + 1:], ' ') AS y, k FROM (SELECT *, unnest(range(1, d)) AS k FROM cand)),
cut AS (
  SELECT p.lang, p.phrase, p.a, b.a AS l, c.a AS r, n, CAST((1000::HUGEINT * p.a * n) // (b.a::HUGEINT * c.a) AS BIGINT) AS score, k
  FROM part p JOIN f b ON b.lang = p.lang AND b.phrase = x JOIN f c ON c.lang = p.lang AND c.phrase = y JOIN n ON n.lang = p.lang),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cut) WHERE o = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(s[i:j], ' ') AS phrase, a FROM (SELECT *, unnest(range(i + 1, d + 1)) AS j FROM (SELECT *, unnest(range(1, d)) AS i FROM cand)) WHERE j - i + 1 < d),
left_ AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inside q WHERE q.lang = low.lang AND q.phrase = low.phrase AND q.a >= low.a))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op10_exact_top_k": OP10_SQL,
    "op13_collocations": OP13_SQL,
}
