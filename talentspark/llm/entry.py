"""Queries of this subpackage and the SQL that can express them."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_topk, importance, language_id, packing, pii_crf, quality_ranking, quality_rules, secret_scan, sentencepiece_bpe, simhash, token_alignment, toxicity
from .runtime import table


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; only its place is used, never a copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_ranking.rank_quality(docs, quality_ranking.train(docs, table(spark, sf_dir, "labels")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = vars(sys.modules[__name__])
    return {k: f for k, f in own.items() if k.startswith("op") and callable(f)} | {"pipeline": pipeline}


_BLANK = r"\x20\x09-\x0D"
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_OP5 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{_BLANK}]')) AS ls
  FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(covered.n, 0)::bigint AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ls, lambda l: regexp_matches(l, '^\s*(?:[-*•]|[0-9]+[.)])\s'))) AS n_marked,
         len(list_intersect(list_distinct(ws), [{_STOPS}])) AS stop_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       coalesce(NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND word_chars / n_words BETWEEN 1.5 AND 25.0 AND n_symbols / n_words <= 0.3
         AND (n_words < 30 OR n_dup_lines / n_lines <= 0.5) AND (n_words < 60 OR stop_words >= 2)
         AND (n_words < 50 OR n_marked / n_lines <= 0.9), false) AS kept
FROM m"""
_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(embedding::double[], embedding::double[]) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::bigint AS n_links, c.component_id, c.component_id = vec_id AS kept
FROM embeddings JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""

_OP12 = """
WITH RECURSIVE step AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
found AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
uses AS (SELECT side, id, w, count(*) AS n FROM (SELECT side, id, unnest(ws) AS w FROM found) GROUP BY ALL),
digits AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM uses)),
buckets AS (
  SELECT w, xor(list_reduce(
    list_concat([4294967295::bigint], list_transform(range(0, length(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS b
  FROM digits, crc),
counted AS (SELECT b, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM uses JOIN buckets USING (w) GROUP BY b),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM counted),
gain AS (SELECT b, floor(1000 * ln(((counted.t + 1)::double * (total.s + 10000)::double) / ((counted.s + 1)::double * (total.t + 10000)::double)))::bigint AS g FROM counted, total),
weight AS (SELECT id, sum(n * g)::bigint AS weight FROM uses JOIN buckets USING (w) JOIN gain USING (b) WHERE side = 'd' GROUP BY id),
hash AS (SELECT id, len(ws)::bigint AS n_features, sha256('2024:' || id::varchar) AS x FROM found WHERE side = 'd'),
drawn AS (
  SELECT id AS doc_id, n_features, coalesce(weight, 0)::bigint AS weight,
    list_reduce(list_concat([0::bigint], list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(x, i, 1)) - 1)::bigint)), lambda a, d: a * 16 + d) AS h
  FROM hash LEFT JOIN weight USING (id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM drawn),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, floor(10 * count(*) OVER () / 100) AS most
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
_OP13 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::double)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::integer AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op12_importance_resampling": _OP12, "op13_exact_topk": _OP13, "op5_quality_rules": _OP5, "op8_embedding_dedup": _OP8}
