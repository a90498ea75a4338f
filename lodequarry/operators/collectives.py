"""Collectives across ranks: what each call's members make of it, and loops of ranks paired by what they repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summaries(members: DataFrame, keys: Sequence[str], member: str, expected: DataFrame, group: str) -> DataFrame:
    """By collective: members seen and missing (against those expected of its group), skews of start and duration, status and confidence."""
    seen = members.groupBy(*keys, group).agg(F.array_sort(F.collect_set(member)).alias("members"), (F.max("start_ns") - F.min("start_ns")).alias("start_skew_ns"), (F.max(F.col("end_ns") - F.col("start_ns")) - F.min(F.col("end_ns") - F.col("start_ns"))).alias("duration_skew_ns"))
    want = expected.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("expected"))
    met = seen.join(want, group, "left").withColumn("missing", F.array_except("expected", "members"))
    status = F.when(F.size("members") == 1, "singleton").when(F.size("missing") == 0, "complete").otherwise("partial")
    out = met.withColumn("status", status)
    # fixed values: the confidence of each status
    confidence = F.when(F.col("status") == "complete", 0.85).when(F.col("status") == "partial", 0.55).otherwise(0.35)
    return out.select(*keys, group, F.size("members").cast("long").alias("n_members"), F.size("missing").cast("long").alias("n_missing"), "start_skew_ns", "duration_skew_ns", "status", confidence.alias("confidence"))


def loop_pairs(loops: DataFrame, signature: str, member: str, order: Sequence[str], loop_id: str) -> DataFrame:
    """Loops of different members that repeat one motif, paired with those of the first member by their ordinal: signature, ordinal, first_loop, member, loop."""
    numbered = loops.withColumn("ordinal", F.row_number().over(Window.partitionBy(signature, member).orderBy(*order)) - 1)
    lead = numbered.groupBy(signature).agg(F.min(member).alias("_lead"))
    first = numbered.join(lead, signature).where(F.col(member) == F.col("_lead")).select(signature, "ordinal", F.col(loop_id).alias("first_loop"))
    return numbered.join(lead, signature).where(F.col(member) != F.col("_lead")).join(first, [signature, "ordinal"]).select(signature, "ordinal", "first_loop", member, F.col(loop_id).alias("loop"))
