"""The operators over whole tables, with the parameters they would have in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cws, langid, merkle, mixing, pieces, quality, runindex, secrets, simhash, urlfilter
from .common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*cols)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return merkle.audit(pages, merkle.damaged_copy(pages))


def op3_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "component", "decided")


def op4_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir, "doc_id", "text"), width=3, radius=3)


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_docs(spark, sf_dir, "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")


def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.remove_repeats(_docs(spark, sf_dir, "doc_id", "text"), length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir, "doc_id", "text"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_edits(_docs(spark, sf_dir, "doc_id", "text"), blocks=4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def op9_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_docs(spark, sf_dir, "doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op10_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir, "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "cosine")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mix_sources, op2_warc_fixity, op3_url_equivalence, op4_simhash_trees, op5_weak_supervision, op6_run_length_index, op7_secret_scan, op8_weighted_sampling, op9_piece_table, op10_language_profiles)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_warc_fixity": OP2_SQL, "op3_url_equivalence": OP3_SQL}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '|' || text, '')) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM s
), c AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / w, source ASC NULLS LAST) AS place FROM w
), l AS (
  SELECT c.*, ((SELECT sum(source_size) FROM c) - coalesce((SELECT sum(x.cap) FROM c x WHERE x.place < c.place), 0)) / (SELECT sum(x.w) FROM c x WHERE x.place >= c.place) AS level FROM c
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT min_by(level, place) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS budget, d.draw,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
    CAST(sum(d.size) OVER (PARTITION BY d.source, d.draw) AS BIGINT) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) AS taken
FROM r
"""

OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS BIGINT) % 97 AS pick, length(html) AS n FROM pages
), q AS (
  SELECT *, CASE WHEN pick = 0 AND n > 0 THEN substr(html, 1, n // 2) || CASE WHEN substr(html, n // 2 + 1, 1) = '#' THEN '@' ELSE '#' END || substr(html, n // 2 + 2)
    WHEN pick = 1 AND n > 0 THEN substr(html, 1, n - 1) ELSE html END AS copy FROM p
), w AS (
  SELECT page_id, pick, copy, html,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM q
), r AS (
  SELECT page_id, pick, copy <> html AS changed, head || CAST(octet_length(encode(html)) AS VARCHAR) || gap || html || gap AS a, head || CAST(octet_length(encode(copy)) AS VARCHAR) || gap || copy || gap AS b FROM w
), o AS (
  SELECT *, page_id // 4096 AS file, CAST(octet_length(encode(a)) AS BIGINT) AS length,
    CAST(coalesce(sum(octet_length(encode(a))) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r
)
SELECT page_id, file, "offset", length, sha256(a) AS primary_hash, CASE WHEN pick = 2 THEN NULL ELSE sha256(b) END AS replica_hash, CASE WHEN pick = 2 THEN 'missing' ELSE 'altered' END AS fault
FROM o WHERE pick = 2 OR changed
"""

#: Components by spelling. Links out of the html are not said here: it equals the query on tables whose pages hold no canonical, og:url or refresh tag, as the given ones.
OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, contains(coalesce(url, ''), '://') AS known,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    [x FOR x IN string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&') IF x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)')] AS kept
  FROM pages
), k AS (
  SELECT *, CASE WHEN known THEN regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:/index)?\.html?$|/+$', '', 'g') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
), r AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM k
), g AS (
  SELECT key, least(min(url), key) AS component, coalesce(bool_or(said = 'block'), false) AND NOT coalesce(bool_or(said = 'allow'), false) AS blocked FROM r WHERE key IS NOT NULL GROUP BY key
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, component,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN blocked THEN 'alias' ELSE 'none' END AS decided
FROM r LEFT JOIN g ON r.key = g.key
"""
