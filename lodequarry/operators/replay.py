"""Replays of captured graphs: units that repeat exactly, their cost with a reason where none can be given, annotated timelines, marked segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequarry.operators.intervals import busy
from lodequarry.operators.relations import signatures


def exact_units(members: DataFrame, launch: str, identity: str, order: Sequence[str], symbol: str, least: int = 2) -> DataFrame:
    """Launches whose body repeats: launch, identity, template, repeats and state.

    exact needs at least `least` launches of one body and one body per identity; else few_repeats or several_bodies."""
    body = signatures(members, [launch, identity], order, symbol)
    repeats = F.count("*").over(Window.partitionBy("template"))
    bodies = body.groupBy(identity).agg(F.count_distinct("template").alias("_bodies"))
    met = body.withColumn("repeats", repeats).join(bodies, identity)
    return met.select(launch, identity, "template", "repeats", F.when(F.col("_bodies") > 1, "several_bodies").when(F.col("repeats") < least, "few_repeats").otherwise("exact").alias("state"))


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, null if none does; a null check has failed."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(name)
    return out


def unit_costs(units: DataFrame, members: DataFrame, unit: str, expected: str) -> DataFrame:
    """Units (with the number of members expected) with the union, sum and envelope of their members (start_ns, end_ns, resolved), and a reason in place of costs
    where members are missing, unresolved, reversed or more than expected."""
    seen = members.groupBy(unit).agg(F.count("*").alias("_n"), F.bool_and("resolved").alias("_resolved"), F.bool_and(F.col("end_ns") >= F.col("start_ns")).alias("_forward"))
    cost = busy(members, [unit])
    met = units.join(seen, unit, "left").join(cost, unit, "left")
    reason = first_reason([("no_members", F.col("_n").isNotNull()), ("unresolved_member", F.col("_resolved")), ("reversed_member", F.col("_forward")), ("missing_members", F.col("_n") >= F.col(expected)), ("surplus_members", F.col("_n") <= F.col(expected))])
    out = met.withColumn("reason", reason)
    keep = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return out.select(unit, "reason", keep("union_ns"), keep("sum_ns"), keep("envelope_ns"))


def chosen_order(launches: DataFrame, keys: Sequence[str], host_at: str, device_at: str, launch: str) -> DataFrame:
    """launches with `position`: by host submission where every launch of a key has one, else by device time; and which it was."""
    whole = F.bool_and(F.col(host_at).isNotNull()).over(Window.partitionBy(*keys))
    at = F.when(F.col("_whole"), F.col(host_at)).otherwise(F.col(device_at))
    out = launches.withColumn("_whole", whole)
    w = Window.partitionBy(*keys).orderBy(at, launch)
    return out.withColumns({"position": F.row_number().over(w) - 1, "order_basis": F.when(F.col("_whole"), "host_submission").otherwise("device_time")}).drop("_whole")


def marked_segments(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], ends: Column, label: Column) -> DataFrame:
    """Segments that end with a marked token: keys, segment (from 0), tokens, label (the smallest label of its tokens, null without) and closed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seat = F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = tokens.withColumns({"segment": seat, "_end": ends, "_label": label})
    return marked.groupBy(*keys, "segment").agg(F.count("*").alias("tokens"), F.min("_label").alias("label"), F.max("_end").alias("closed"))


def annotated(anchors: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anchors (anchor_idx) with the region (region_id, first_idx, last_idx) they lie in: none, one or several (then no region is named).

    Regions are opened to the indices they cover, which bounds the join by their total length."""
    each = regions.select(*keys, "region_id", F.explode(F.sequence("first_idx", "last_idx")).alias("anchor_idx")).groupBy(*keys, "anchor_idx").agg(F.count("*").alias("n_regions"), F.min("region_id").alias("region_id"))
    met = anchors.join(each, [*keys, "anchor_idx"], "left")
    n = F.coalesce("n_regions", F.lit(0))
    return met.withColumns({"region_id": F.when(n == 1, F.col("region_id")), "annotation": F.when(n == 0, "none").when(n == 1, "one").otherwise("ambiguous")}).drop("n_regions")
