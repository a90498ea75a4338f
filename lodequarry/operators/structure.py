"""Trees of execution: roots, walks, paths, roll-ups from the leaves, slots and positions, and what must hold of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roots(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Nodes that are no node's child."""
    return edges.select(F.col(parent).alias("node")).distinct().join(edges.select(F.col(child).alias("node")), "node", "left_anti")


def _kept(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed where the session has a folder for it, else persisted, so that an executor's loss is made good from the lineage."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def walk(edges: DataFrame, most: int = 64) -> DataFrame:
    """Every node with its parent, depth from its root, root and path (joined by /), level by level.

    The edges and each level are computed once; a level is joined to the edges only; the loop ends with the first empty level. ValueError beyond `most` levels, which a cycle would reach."""
    edges = _kept(edges)
    level = roots(edges).select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col("node").alias("root"), F.col("node").cast("string").alias("path"))
    out = level
    for depth in range(1, most + 2):
        level = level.select(F.col("node").alias("parent"), "root", "path").join(edges, "parent").select(F.col("child").alias("node"), "parent", F.lit(depth).alias("depth"), "root", F.concat_ws("/", "path", "child").alias("path"))
        level = _kept(level)
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError(f"the tree is deeper than {most} levels, or has a cycle")


def ancestors(tree: DataFrame) -> DataFrame:
    """node and each ancestor from itself to its root, by the path."""
    return tree.select("node", F.explode(F.split("path", "/")).alias("ancestor"))


def rolled_up(tree: DataFrame, leaves: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """By node, the sums of the leaves (node, ...) at or below it. Leaves are summed by node before they meet their ancestors."""
    names = list(sums)
    own = leaves.groupBy("node").agg(*(v.alias(k) for k, v in sums.items()))
    return ancestors(tree).join(own, "node").groupBy(F.col("ancestor").alias("node")).agg(*(F.sum(k).alias(k) for k in names))


def folded_runs(runs: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """Tree rows of runs (see sequence.runs): a root per key, a repeat for runs of at least `least`, atoms below: node, parent, kind, symbol, repeats, first_pos, last_pos."""
    name = lambda *parts: F.concat_ws(":", *[F.col(k).cast("string") for k in keys], *parts)
    top = runs.groupBy(*keys).agg(F.max("last_pos").alias("last_pos")).select(*keys, name(F.lit("root")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("root").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(1).cast("long").alias("repeats"), F.lit(0).alias("first_pos"), "last_pos")
    many = F.col("length") >= least
    rep = runs.where(many).select(*keys, name(F.lit("run"), "run").alias("node"), name(F.lit("root")).alias("parent"), F.lit("repeat").alias("kind"), "symbol", F.col("length").alias("repeats"), "first_pos", "last_pos")
    each = runs.withColumn("pos", F.explode(F.sequence("first_pos", "last_pos")))
    atom = each.select(*keys, name(F.lit("atom"), "pos").alias("node"), F.when(many, name(F.lit("run"), "run")).otherwise(name(F.lit("root"))).alias("parent"), F.lit("atom").alias("kind"), "symbol", F.lit(1).cast("long").alias("repeats"), F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos"))
    return top.unionByName(rep).unionByName(atom)


def faults(tree: DataFrame) -> DataFrame:
    """Rows that break a rule, with its name: a span that ends before it begins, a missing parent, a child that leaves its parent's span."""
    spans = tree.where("last_pos < first_pos").select("node", F.lit("empty_span").alias("fault"))
    up = tree.select(F.col("node").alias("parent"), F.col("first_pos").alias("a"), F.col("last_pos").alias("b"))
    met = tree.where("parent is not null").join(up, "parent", "left")
    orphan = met.where("a is null").select("node", F.lit("missing_parent").alias("fault"))
    outside = met.where("first_pos < a or last_pos > b").select("node", F.lit("outside_parent").alias("fault"))
    return spans.unionByName(orphan).unionByName(outside)


def ordinals(edges: DataFrame, parent: Sequence[str], order: Sequence[str], role: str | None = None) -> DataFrame:
    """edges with `ordinal` from 0 within a parent, and within its role if one is named."""
    return edges.withColumn("ordinal", F.row_number().over(Window.partitionBy(*parent, *([role] if role else [])).orderBy(*order)) - 1)


def occurrence_rows(placements: DataFrame, keys: Sequence[str], costs: Sequence[str]) -> DataFrame:
    """Occurrences of nodes: anchors, their first and last index, start and end, and sums of the costs, rounded to the nanosecond."""
    return placements.groupBy(*keys).agg(F.min("anchor_idx").alias("anchor_start_idx"), F.max("anchor_idx").alias("anchor_end_idx"), F.count("*").alias("anchor_count"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), *(F.round(F.coalesce(F.sum(c), F.lit(0.0)), 3).alias(c) for c in costs))


def agreed_slots(slots: DataFrame, definition: str, occurrence: str, order: Sequence[str], symbol: str) -> DataFrame:
    """By definition, whether all its occurrences show the same slots in order: definition, occurrences, signatures, agrees, slots (of the smallest signature)."""
    per = slots.groupBy(definition, occurrence).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(symbol).alias("_s")))).alias("x"))
    per = per.select(definition, occurrence, F.array_join(F.transform("x", lambda y: y["_s"]), ">").alias("s"))
    by = per.groupBy(definition).agg(F.count("*").alias("occurrences"), F.count_distinct("s").alias("signatures"), F.min("s").alias("slots"))
    return by.select(definition, "occurrences", "signatures", (F.col("signatures") == 1).alias("agrees"), "slots")


def per_repeat(total: Column, occurrences: Column, repeats: Column) -> Column:
    """A total for one time of one occurrence; the total itself where neither is counted."""
    return F.round(total / F.when(F.coalesce(occurrences, F.lit(0)) == 0, 1).otherwise(occurrences * F.when(F.coalesce(repeats, F.lit(0)) > 0, repeats).otherwise(1)), 3)


def readable(tree: DataFrame) -> DataFrame:
    """node and a line of text, indented by depth, with the share of children beside it."""
    n = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "node")
    met = tree.join(n, "node", "left")
    return met.select("node", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("node"), F.lit(" ("), F.coalesce("children", F.lit(0)).cast("string"), F.lit(")")).alias("line"))
