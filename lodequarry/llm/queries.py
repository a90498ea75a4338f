"""The queries opN_<name> and the pipeline, with the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequarry.llm import chat, licenses, lm, mixing, neardup, packing, quality, shared, sharding, tokenfiles, vectors

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    out = sharding.shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.scratch_path(spark, "token-files")
    tokenfiles.write(_table(spark, sf_dir, "documents"), path)
    return tokenfiles.read(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = shared.staged(quality.measured(docs).drop("text"), "quality-measures")
    cutoffs = quality.calibrate(quality.labels_of(measured, _table(spark, sf_dir, "labels")))
    out = quality.judged(measured, cutoffs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    return chat.read_back(chat.formatted(rows.union(spark.createDataFrame(hard, rows.schema))))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm.score(_table(spark, sf_dir, "documents"), held_out)


def op8_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, its language, one of 64 directories by id, and its id; a document whose first line has a licence word is its directory's licence file."""
    heads = F.lower(F.substring_index("text", "\n", 1)).rlike("licen[cs]e|rights reserved")
    name = F.when(heads, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id") % 64, name).alias("path"), "text")
    return licenses.scan(docs).select("doc_id", "license", "license_score", "license_basis", "license_from")


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_files": op3_token_files,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_packing": op6_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_vector_duplicates": op8_vector_duplicates,
    "op9_mixing": op9_mixing,
    "op10_licenses": op10_licenses,
}
ORACLES: dict[str, str] = {}
