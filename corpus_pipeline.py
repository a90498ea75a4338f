"""From raw documents to packed training sequences: quality rules, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage works on what its predecessor wrote.

All stages take null texts as empty ones, keep rows alike in all columns apart, give no rows for an empty table, and return columns that they do not read (whatever their names) as they
came. The smallest id wins ties; a null id is larger than all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequarry.llm import mixing, neardup, packing, quality, shared


READ = ("doc_id", "text", "lang", "source")


def _apart(docs: DataFrame) -> DataFrame:
    """docs with the columns that no stage reads under names that no operator uses."""
    return docs.withColumnsRenamed({c: f"lq_own_{k}" for k, c in enumerate(docs.columns) if c not in READ})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from what an operator made of _apart(docs)."""
    return out.select(*(F.col(c if c in READ else f"lq_own_{k}").alias(c) for k, c in enumerate(docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs certified on the labels, by language (null is one).

    Texts without 50 words, null ones among them, fail the base rules. Without labels, or with too few, the base rules alone decide."""
    measured = shared.staged(quality.measured(_apart(docs)), "quality-measures")
    cutoffs = quality.calibrate(quality.labels_of(measured.drop("text"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _back(quality.judged(measured, cutoffs).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id; texts without words stay all."""
    return _back(neardup.deduplicated(_apart(docs)), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one of its own; texts without words weigh nothing and are taken as their source's share of rows."""
    mixed = mixing.mix(_apart(docs)).where("copies > 0")
    return _back(mixed.withColumn("lq_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence (see packing.pack); a text without tokens is one piece, its end."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("source mix", source_mix), ("packing", packed)]

#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
