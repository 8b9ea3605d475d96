"""Queries opN_<name>: each operator applied to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, dedup, idfile, langid, lm, simhash, tokencount, toxicity
from .common import remainder, table


def held_out(divisor: int, value: int) -> Column:
    return remainder(F.col("doc_id"), divisor) == value


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_trees(chat.thread_rows(rows.unionByName(extra))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.train(docs.filter(~held_out(5, 0)).select("text", "lang"))
    return langid.predict(docs.withColumn("held_out", held_out(5, 0)), profiles, ["doc_id", "held_out"])


def op3_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.histogram(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(5, 0))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).withColumn("held_out", held_out(5, 0))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, ~held_out(7, 2)).withColumn("held_out", held_out(7, 2))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.write_and_read(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_language_id, op3_token_histogram, op4_decontaminate, op5_simhash_near_dedup, op6_byte_bpe, op7_toxicity, op8_lm_score, op9_token_files, op10_exact_dedup)
}

_LINES = """regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '<turn ', '\o') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '<turn ', '\o'), '>', '\g'), chr(10), '\n') AS head
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 16) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op10_exact_dedup": f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256({_LINES}) AS text_sha256 FROM documents),
k AS (SELECT text_sha256, count(*) AS group_size,
  (list(doc_id ORDER BY chars DESC, doc_id))[1] AS keep_id FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN k USING (text_sha256)""",
}
