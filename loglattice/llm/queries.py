"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .katz_lm import score_documents
from .language_id import identify_languages
from .lexical_search import lexical_search
from .license_scan import scan_licences
from .line_dedup import lines_by_document
from .minhash_dedup import near_duplicates
from .mixing import take_words
from .packing import packed_pieces
from .prefix_trie import rebuilt_trie
from .quality_rules import judge_quality
from .topk_search import nearest
from .url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


# The rules of the contract, as host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op4_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_by_document(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_url_filter, op3_mixing, op4_katz_lm, op5_packing, op6_topk_search, op7_license_scan, op8_language_id, op9_line_dedup, op10_exact_dedup, op11_prefix_trie, op12_quality_rules, op13_lexical_search)}


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule_host, rule_path, of_rule) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), judged AS (
  SELECT page_id, host, path,
    (SELECT max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := of_rule))
     FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parts
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""

OP6_SQL = r"""
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    CAST(list_sum(list_transform(list_zip(q.code, r.code), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM codes q, codes r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

OP10_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept
  FROM bare
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked
"""


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, list(struct_pack(r := role, t := text) ORDER BY place) AS own,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM turns GROUP BY c
), rebuilt AS (
  SELECT v.c, list_concat(coalesce(b.own[1:v.h], []), v.own[v.h + 1:len(v.own)]) AS seq FROM convs v LEFT JOIN convs b ON b.c = v.c - v.c % 5
), prefixes AS (
  SELECT c, CAST(len(seq) AS BIGINT) AS size, d AS depth, seq[1:d] AS p FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt) x
), nodes AS (
  SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs, max(size) AS longest, (count(*) - 1) * coalesce(strlen(p[depth].t), 0) AS saved,
    sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM prefixes GROUP BY p, depth
), above AS (
  SELECT p[1:a] AS p, a AS depth, sum(saved) AS saved_tokens, count(*) FILTER (WHERE depth = longest) AS n_leaves, count(*) FILTER (WHERE depth = a + 1) AS n_children
  FROM (SELECT p, depth, saved, longest, unnest(range(depth + 1)) AS a FROM nodes) x GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above a ON a.depth = n.depth AND a.p = n.p LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
"""

OP13_SQL = r"""
WITH asked AS (
  SELECT item_id, term, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) t
  GROUP BY item_id, term
), rows AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), docs AS (SELECT row, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM rows WHERE len(words) > 0),
sizes AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
norms AS (SELECT row, doc_id, 75 + (25 * n * docs) // terms AS m FROM docs, sizes),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM docs) t WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term) t, sizes),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (row) GROUP BY item_id, row, doc_id
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op6_topk_search": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_lexical_search": OP13_SQL}
