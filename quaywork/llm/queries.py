"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_to_warc, chat_format, decontamination, embedding_dedup, ngram_jaccard, packing, periodic_runs, quality, sharding, substring_dedup, suffix_dedup, toxicity, whitening
from .common import scratch, table

#: The two rows that a template must carry without taking their text for its own marks.
TRICKY = r"\### Assistant: </turn> ok"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.fuzzy_passages(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), with_text=False))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_to_warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, f"warc-{uuid.uuid4().hex}"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat_format.digest(chat_format.read_chats(chat_format.format_chats(given.union(tricky))))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.plant(table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_ngram_jaccard, op3_decontamination, op4_arc_to_warc, op5_suffix_dedup, op6_embedding_dedup, op7_chat_format, op8_sharding, op9_packing, op10_toxicity, op11_periodic_runs, op12_whitening, op13_quality)
}
_BY = "ORDER BY turn NULLS FIRST, role, text"
_LONGER = "4 * (length({0}) - length(replace({0}, '&', ''))) + 3 * ((length({0}) - length(replace({0}, '<|', ''))) // 2)"

#: Of the others, the engine of the check has no checksum, tokenizer, language model, suffix array or graph search.
ORACLE_SQL: dict[str, str] = {
    "op7_chat_format": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
 o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id {_BY}) AS before FROM c),
 m AS (SELECT *, CASE WHEN before = role THEN 8 ELSE 9 + length(role) + {_LONGER.format("role")} + CASE WHEN before IS NULL THEN 0 ELSE 8 END END + length(text) + {_LONGER.format("text")} AS chars FROM o)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_BY})) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' {_BY}), '')) AS loss_sha256, CAST(sum(chars) + 8 AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id""",
}
