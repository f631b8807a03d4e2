"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqspark.llm.common import shared_dir
from seqspark.llm.ngram_join import ngram_jaccard_components
from seqspark.llm.packing import pack_documents
from seqspark.llm.quality_rules import quality_rules
from seqspark.llm.source_mix import mix_counts
from seqspark.llm.substring_dedup import word_window_dedup
from seqspark.llm.suffix_dedup import suffix_dedup
from seqspark.llm.token_counts import token_counts
from seqspark.llm.token_store import read_store, write_store
from seqspark.llm.url_filters import url_filter
from seqspark.llm.vp_search import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op1_token_counts"] = op1_token_counts


#: The rules of the query, as (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(_table(spark, sf_dir, "pages"), listed)


QUERIES["op9_url_filters"] = op9_url_filters
_rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLE["op9_url_filters"] = f"""
WITH rules(rh, rp, rv) AS (VALUES {_rules}),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS rid
  FROM pages),
m AS (
  SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


QUERIES["op10_quality_rules"] = op10_quality_rules
ORACLE["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (SELECT rid, i, ws[i:i+2] AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
nl AS (
  SELECT rid, source, list_transform(ls, lambda x: translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ns
  FROM w WHERE len(ls) > 0),
held AS (SELECT DISTINCT coalesce('=' || source, '') AS host, md5(array_to_string(ns, chr(10))) AS doc, unnest(ns) AS line FROM nl),
hosts AS (SELECT host, count(DISTINCT doc) AS docs FROM held GROUP BY host),
bad AS (SELECT host, line FROM held JOIN hosts USING (host) GROUP BY host, line, docs HAVING count(*) > 20 AND count(*) > 0.1 * docs),
lost AS (
  SELECT rid, sum(len(string_split(line, ' '))) AS n
  FROM (SELECT rid, coalesce('=' || source, '') AS host, unnest(ns) AS line FROM nl) JOIN bad USING (host, line) GROUP BY rid),
b AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(lost.n, 0) <= 0.5 * n_words AS kept
FROM b LEFT JOIN lost USING (rid)
"""


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), size=3, num=9, den=10)


QUERIES["op2_ngram_jaccard"] = op2_ngram_jaccard


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_window_dedup(_table(spark, sf_dir, "documents"), window=35)


QUERIES["op4_substring_dedup"] = op4_substring_dedup


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


QUERIES["op8_suffix_dedup"] = op8_suffix_dedup


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_store(spark, path)


QUERIES["op5_token_store"] = op5_token_store


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(_table(spark, sf_dir, "documents"))


QUERIES["op3_best_fit_packing"] = op3_best_fit_packing
QUERIES["op7_source_mix"] = op7_source_mix


def op6_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


QUERIES["op6_vp_search"] = op6_vp_search
ORACLE["op6_vp_search"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
