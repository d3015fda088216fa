"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import nn_descent
from lexloom.llm.chat_format import conversation_events, digest, format_chats
from lexloom.llm.context_mixing import score_texts
from lexloom.llm.language_id import languages
from lexloom.llm.mixing import mix_sources
from lexloom.llm.near_dedup import near_duplicates
from lexloom.llm.packing import pack
from lexloom.llm.robust_outliers import quality_outliers
from lexloom.llm.rule_ensemble import quality_scores
from lexloom.llm.suffix_dedup import PASSAGE_WORDS, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Conversation -1 holds the template's own marks in both texts.
MARKS = "<|im_end|><|im_start|>assistant ok"


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), with_text=False, passages=PASSAGE_WORDS)


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{MARKS}' AS text")
    return digest(format_chats(conversation_events(rows.union(marks))))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_tokens", "mix_place")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '{MARKS}'), (-1, 1, 'assistant', '{MARKS}')
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(length(role) + (length(role) - length(replace(role, chr(92), ''))) + (length(role) - length(replace(role, chr(10), ''))) + (length(role) - length(replace(role, '<|', ''))) // 2
    + length(text) + (length(text) - length(replace(text, chr(92), ''))) + (length(text) - length(replace(text, '<|', ''))) // 2 + 24)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nn_descent, op2_robust_outliers, op3_suffix_dedup, op4_rule_ensemble, op5_best_fit_packing, op6_chat_format, op7_temperature_mixing, op8_language_id, op9_minhash_near_dedup, op10_context_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_nn_descent": nn_descent.ORACLE_SQL, "op6_chat_format": CHAT_SQL}
