"""The registered queries of the training-data operators: each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from surprisal.llm import bpe, chat, decontam, html_extract, langid, pii, quality, simhash, sstable, winnow
from surprisal.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
#: A conversation whose texts hold control strings of a common template, formatted with all others (fixed value).
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@lru_cache(1)
def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(rows.union(spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe, op2_html, op3_pii, op4_langid, op5_chat, op6_quality, op7_decontamination, op8_simhash, op9_sstable, op10_winnowing, pipeline)
    return {f.__name__: f for f in found}


#: Escaping adds one character where a control string begins (any backslashes behind its first character included).
_CONTROL_SQL = r"<\\*\|(?:im_start|im_end|endoftext|startoftext|system|user|assistant)\|>|<\\*/?s>|<\\*(?:unk|pad)>|\[\\*/?INST\]|<\\*</?SYS>>|<\\+n>"

CHAT_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL_SQL}')) + len(regexp_extract_all(text, '{_CONTROL_SQL}'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

DECONTAMINATION_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (
  SELECT id AS item_id, words, least(13, len(words)) AS n FROM w WHERE kind = 'i' AND len(words) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[p : p + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, CAST(len(words) - n + 2 AS BIGINT))) AS p FROM items)
), docs AS (
  SELECT id AS doc_id, words FROM w WHERE kind = 'd'
), doc_windows AS (
  SELECT doc_id, n, p, array_to_string(words[p : p + n - 1], ' ') AS win
  FROM (SELECT d.*, s.n, unnest(range(1, CAST(len(d.words) - s.n + 2 AS BIGINT))) AS p FROM docs d, (SELECT DISTINCT n FROM items) s WHERE len(d.words) >= s.n)
), found AS (
  SELECT d.doc_id, d.p, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.win = i.win
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
  sha256(coalesce(l.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force, round trips or held-out accuracy."""
    return {"op5_chat": CHAT_SQL, "op7_decontamination": DECONTAMINATION_SQL}
