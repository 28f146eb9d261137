"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvspark.llm import decontaminate, importance, pieces, pii, quality_rules, secrets, simhash, suffixes, token_counts, url_rules
from kvspark.llm.base import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_two_tier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op8_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op9_interval_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_importance_resampling, op2_entropy_secrets, op3_decision_list, op4_segment_popcount, op5_spaced_seeds,
    op6_two_tier_tokens, op7_checked_pii, op8_suffix_merge, op9_interval_urls, op10_merge_dropout,
)}

ORACLES = {
    "op2_entropy_secrets": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT rid, 'assign' AS kind, 0 AS rank, regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits, regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS parts, string_split_regex(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM d
  UNION ALL SELECT rid, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]{14,}'), [], string_split_regex(t, 'AKIA[A-Z0-9]{14,}') FROM d
  UNION ALL SELECT rid, 'hex', 2, regexp_extract_all(t, '[0-9a-f]{16,}'), [], string_split_regex(t, '[0-9a-f]{16,}') FROM d
  UNION ALL SELECT rid, 'run', 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), [], string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}') FROM d),
each AS (SELECT rid, kind, rank, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0),
placed AS (
  SELECT rid, kind, rank, hits[i] AS hit, parts[i] AS part,
         length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS s FROM each),
base AS (SELECT rid, kind, rank, s, s + length(hit) AS e FROM placed WHERE kind <> 'run' AND (kind <> 'assign' OR length(part) >= 12)),
runs AS (
  SELECT rid, s, hit, CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN 3.0 WHEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') THEN 3.7 ELSE 4.1 END AS bits
  FROM placed WHERE kind = 'run'
    AND NOT regexp_matches(hit, '(?i)example|sample|dummy|placeholder|changeme') AND NOT regexp_matches(hit, '^[^0-9]*$')
    AND NOT regexp_matches(hit, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AND NOT regexp_matches(hit, '^[0-9]+([-_/+=][0-9]+)*$')),
windows AS (SELECT rid, s, bits, i, substr(hit, i + 1, 20) AS w FROM (SELECT *, unnest(range(0, length(hit) - 19)) AS i FROM runs)),
letters AS (SELECT rid, s, bits, i, c, count(*) AS n FROM (SELECT *, unnest(string_split(w, '')) AS c FROM windows) GROUP BY ALL),
hot AS (SELECT rid, s, i FROM letters GROUP BY rid, s, bits, i HAVING log2(20) - sum(n * log2(n)) / 20 >= bits),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY rid, s ORDER BY i) + 20 THEN 0 ELSE 1 END AS fresh FROM hot),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, s ORDER BY i) AS g FROM marked),
entropy AS (SELECT rid, 'entropy' AS kind, 3 AS rank, s + min(i) AS s, s + max(i) + 20 AS e FROM islands GROUP BY rid, s, g),
extra AS (SELECT * FROM entropy x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s < x.e AND x.s < b.e)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
texts AS (
  SELECT rid, string_agg(kind || ':' || cast(s AS bigint) || ':' || cast(e AS bigint), ',' ORDER BY s, rank) AS all_spans,
         string_agg(kind || ':' || cast(s AS bigint) || ':' || cast(e AS bigint), ',' ORDER BY s, rank) FILTER (rank < 3) AS base_spans,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(all_spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN texts USING (rid)
""",
    "op9_interval_urls": """
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1), 'allow') AS verdict
FROM parsed
""",
}
