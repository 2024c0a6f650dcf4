"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import crossparse, edits, languages, media, packing, pieces, simhash, substrings, topk, urlrules
from quire.llm.shared import read_table, vocabulary


#: The rules that op6 applies.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op1_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against the text of all others."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return crossparse.score(docs.withColumn("in_reference", F.lit(True)))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identify(read_table(spark, folder, "documents"))


def op3_edit_aware_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document before and after its mail addresses and long numbers are replaced."""
    return edits.edited_counts(read_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op4_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    found = media.text_media(read_table(spark, folder, "documents"))
    return found.drop("digest")


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(read_table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    return urlrules.judge(pages, urlrules.rule_table(spark, URL_RULES)).drop("url")


def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(read_table(spark, folder, "embeddings"))


def op8_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", hexadecimal, "n_near", "component_id")


OPERATORS = (
    op1_cross_parsing,
    op2_language_id,
    op3_edit_aware_counts,
    op4_media_columns,
    op5_sentencepiece,
    op6_url_rules,
    op7_exact_top_k,
    op8_harmonic_packing,
    op9_substring_dedup,
    op10_simhash_near_dedup,
)

OP6_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.host, s.path ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC)
           AS place
  FROM (SELECT DISTINCT host, path, min(page_id) AS page_id FROM split GROUP BY host, path) s
  JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON s.host = f.host AND s.path = f.path
"""

OP7_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""

OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), firsts AS (
  SELECT win, min(doc_id) AS first FROM g GROUP BY win
), hit AS (
  SELECT DISTINCT g.doc_id, g.i + k AS p FROM g JOIN firsts USING (win) CROSS JOIN (SELECT unnest(range(0, 13)) AS k)
  WHERE first < g.doc_id
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n
  FROM each e ANTI JOIN hit h ON e.doc_id = h.doc_id AND e.p = h.p GROUP BY e.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_rules": OP6_SQL, "op7_exact_top_k": OP7_SQL, "op9_substring_dedup": OP9_SQL}
