"""The operators' queries over the documents table, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemolake.llm import bpe, fingerprints, lines, minhash, packing, pii, quality, substrings, suffixes, toxicity
from mnemolake.llm.base import documents
from mnemolake.shipping import ship

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.calibrated(*toxicity.sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.scored(docs, model)


def _plain(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(documents(ship(spark), sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": _plain(minhash.classes),
    "op2_best_fit_packing": _plain(packing.packed),
    "op3_bpe": _plain(lambda docs: bpe.digests(docs, vocabulary())),
    "op4_quality_rules": _plain(quality.judged),
    "op5_fingerprints": _plain(fingerprints.digests),
    "op6_pii": _plain(pii.detected),
    "op7_substring_dedup": _plain(substrings.digests),
    "op8_line_dedup": _plain(lines.digests),
    "op9_suffix_dedup": _plain(suffixes.digests),
    "op10_toxicity": lambda spark, sf_dir: _toxicity(ship(spark), sf_dir),
}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
_WORD = r"[^\x20\x09-\x0D]"

ORACLE: dict[str, str] = {
    "op4_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
  FROM documents
), x AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), g AS (
  SELECT doc_id, i, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS win
  FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g WHERE win IS NOT NULL) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM d) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, len(regexp_extract_all(array_to_string(ws, ''), '!'))::BIGINT AS n_exclaim,
         len(regexp_extract_all(array_to_string(ws, ''), '[A-Z]'))::BIGINT AS n_upper,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop
  FROM w LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words > 0 AND word_chars / n_words BETWEEN 1.5 AND 14.0 AND n_symbols / n_words <= 0.25
       AND n_exclaim / n_words <= 0.35 AND n_upper / word_chars <= 0.6 AND n_stop / n_words >= 0.02
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept, n_lines, n_exclaim, n_upper, n_stop
FROM b""",
    "op8_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, line, pos, s.last IS NULL OR s.last = k.doc_id AS stays FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
