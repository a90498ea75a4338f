"""Intervals on a timeline: unions, overlaps, as-of links, ownership and gaps.

All are windows and equi-joins on (keys, time bin); none pairs rows that lie far apart. A bin width should be about the length of a typical interval: an interval is
copied once for each bin it touches, and a pair is reported in one bin only, so that nothing needs to be made distinct.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000_000


def _frontier(keys: Sequence[str], end: str = "end_ns", order: Sequence[str] = ("start_ns", "end_ns")) -> Column:
    """The latest end among the rows before, in order; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.max(end).over(w)


def tasks(*frames: DataFrame, rows: int = 1_000_000) -> int:
    """How many tasks give each about `rows` rows of the frames, which are counted, so that what one sorts at once does not grow with them; the session's number of shuffle partitions at least."""
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(df.count() for df in frames) // rows))


def busy(df: DataFrame, keys: Sequence[str], start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """By keys: intervals, the length of their union (touching ones merge), their summed length and their envelope, all in ns."""
    prior = F.coalesce(_frontier(keys, end, (start, end)), F.col(start))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), prior))
    return df.withColumn("_fresh", fresh).groupBy(*keys).agg(F.count("*").alias("intervals"), F.sum("_fresh").alias("union_ns"), F.sum(F.col(end) - F.col(start)).alias("sum_ns"), (F.max(end) - F.min(start)).alias("envelope_ns"))


def busy_binned(df: DataFrame, keys: Sequence[str], bin_ns: int = 24 * HOUR, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """union_ns by keys for few and long key groups: intervals are clipped to time bins, each bin is united on its own, and bins add up."""
    last = F.greatest(F.col(start), F.col(end) - 1)
    bins = df.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_ns), F.floor(last / bin_ns))))
    clipped = bins.select(*keys, "_bin", F.greatest(F.col(start), F.col("_bin") * bin_ns).alias("start_ns"), F.least(F.col(end), (F.col("_bin") + 1) * bin_ns).alias("end_ns"))
    return busy(clipped, [*keys, "_bin"]).groupBy(*keys).agg(F.sum("union_ns").alias("union_ns"))


def islands(df: DataFrame, keys: Sequence[str], start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """The merged intervals of each key: keys, start_ns, end_ns, intervals."""
    prior = _frontier(keys, end, (start, end))
    new = F.when(prior.isNull() | (F.col(start) > prior), 1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w)).groupBy(*keys, "_island").agg(F.min(start).alias("start_ns"), F.max(end).alias("end_ns"), F.count("*").alias("intervals")).drop("_island")


def _bins(df: DataFrame, bin_ns: int, start: str, end: str) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_ns), F.floor(F.col(end) / bin_ns))))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_ns: int = HOUR, closed: bool = False) -> DataFrame:
    """Pairs of rows with equal keys whose intervals (start_ns, end_ns) overlap; right columns of the same names get the prefix r_.

    closed: touching intervals overlap too. A pair belongs to the bin in which its later start lies."""
    taken = set(left.columns) - set(keys)
    r = right.select(*keys, *(F.col(c).alias(f"r_{c}" if c in taken else c) for c in right.columns if c not in keys))
    rs, re_ = ("r_start_ns", "r_end_ns") if "start_ns" in taken else ("start_ns", "end_ns")
    met = _bins(left, bin_ns, "start_ns", "end_ns").join(_bins(r, bin_ns, rs, re_), [*keys, "_bin"])
    over = (F.col("start_ns") <= F.col(re_)) & (F.col(rs) <= F.col("end_ns")) if closed else (F.col("start_ns") < F.col(re_)) & (F.col(rs) < F.col("end_ns"))
    return met.where(over & (F.col("_bin") == F.floor(F.greatest(F.col("start_ns"), F.col(rs)) / bin_ns))).drop("_bin")


def ordered_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], id_column: str, bin_ns: int = HOUR) -> DataFrame:
    """overlap_join() of frames of keys, id, start_ns and end_ns, with observed_order: from 0, by the right start, end and id, within a left id.

    Pairs stay in the task that met them: they are ranked within their bin, behind as many as their left row has in the bins before. Those are counted first, and only the counts move.
    Left ids that repeat are ranked over all their pairs."""
    right_order = ("r_start_ns", "r_end_ns", f"r_{id_column}")
    marked = left.withColumn("_once", F.count("*").over(Window.partitionBy(id_column)) == 1)
    many = overlap_join(marked.where("not _once").drop("_once"), right, keys, bin_ns)
    many = many.withColumn("observed_order", F.row_number().over(Window.partitionBy(id_column).orderBy(*right_order)).cast("long") - 1)
    cut = _bins(marked.where("_once").drop("_once"), bin_ns, "start_ns", "end_ns")
    r = _bins(right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in (id_column, "start_ns", "end_ns"))), bin_ns, "r_start_ns", "r_end_ns")
    later = F.col("_bin") == F.floor(F.greatest("start_ns", "r_start_ns") / bin_ns)
    n = tasks(left, right, rows=10_000)  # a row may have hundreds of pairs
    meet = lambda x: x.repartition(n, *keys, "_bin").join(r.repartition(n, *keys, "_bin"), [*keys, "_bin"]).where((F.col("start_ns") < F.col("r_end_ns")) & (F.col("r_start_ns") < F.col("end_ns")) & later)
    bins = Window.partitionBy(id_column).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = meet(cut).groupBy(*keys, "_bin", id_column).agg(F.count("*").alias("_n")).select(*keys, "_bin", id_column, F.coalesce(F.sum("_n").over(bins), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bin", id_column).orderBy(*right_order))
    one = meet(cut.join(before, [*keys, "_bin", id_column])).withColumn("observed_order", place.cast("long") - 1 + F.col("_before")).drop("_bin", "_before")
    return one.unionByName(many)


def overlap_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, bin_ns: int = HOUR) -> DataFrame:
    """left_id and `n`, the rows of equal keys on the right that overlap or touch the left row, none of them reversed and no left_id twice; without the pairs.

    Those are the starts up to the left end less the ends before the left start. Both are running counts: within a bin of time, and of the bins before, of which there is a row each."""
    mark = lambda df, at, kind, value, i=F.lit(None).cast(left.schema[left_id].dataType): df.select(*keys, F.col(at).alias("_t"), F.lit(kind).alias("_kind"), F.lit(value).alias("_v"), i.alias("_i"))
    # at one time: starts count for an end of the left there, ends only for what comes behind
    marks = mark(left, "start_ns", 0, 0, F.col(left_id)).unionByName(mark(right, "start_ns", 1, 1)).unionByName(mark(left, "end_ns", 2, 0, F.col(left_id))).unionByName(mark(right, "end_ns", 3, 1)).dropna(subset=[*keys, "_t"])
    marks = marks.withColumn("_bin", F.floor(F.col("_t") / bin_ns))
    is_start, is_end = F.when(F.col("_kind") == 1, F.col("_v")).otherwise(0), F.when(F.col("_kind") == 3, F.col("_v")).otherwise(0)
    before = (Window.unboundedPreceding, -1)
    w, bins = Window.partitionBy(*keys, "_bin").orderBy("_t", "_kind"), Window.partitionBy(*keys).orderBy("_bin").rowsBetween(*before)
    count = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    local = marks.withColumns({"_s": count(is_start, w.rowsBetween(*before)), "_e": count(is_end, w.rowsBetween(*before))}).where("_kind in (0, 2)")
    sums = marks.groupBy(*keys, "_bin").agg(F.sum(is_start).alias("_ss"), F.sum(is_end).alias("_ee")).select(*keys, "_bin", count("_ss", bins).alias("_s0"), count("_ee", bins).alias("_e0"))
    met = local.join(sums, [*keys, "_bin"])
    n = F.sum(F.when(F.col("_kind") == 2, F.col("_s") + F.col("_s0")).otherwise(-F.col("_e") - F.col("_e0")))
    return met.groupBy(*keys, F.col("_i").alias(left_id)).agg(n.alias("n"))


def containment_join(outer: DataFrame, inner: DataFrame, keys: Sequence[str], bin_ns: int = HOUR) -> DataFrame:
    """Pairs with equal keys where the right interval lies within the left one; the right one is looked up by the bin of its start."""
    taken = set(outer.columns) - set(keys)
    r = inner.select(*keys, *(F.col(c).alias(f"r_{c}" if c in taken else c) for c in inner.columns if c not in keys)).withColumn("_bin", F.floor(F.col("r_start_ns") / bin_ns))
    return _bins(outer, bin_ns, "start_ns", "end_ns").join(r, [*keys, "_bin"]).where((F.col("r_start_ns") >= F.col("start_ns")) & (F.col("r_end_ns") <= F.col("end_ns"))).drop("_bin")


def following(events: DataFrame, anchors: DataFrame, keys: Sequence[str], at: str, anchor_at: str, anchor_id: str) -> DataFrame:
    """events with `following`: the anchor that starts first at or after `at`, the smallest id of equal starts; null if none follows.

    One union and one window: each event takes the first anchor below it in time order."""
    e = events.withColumns({"_t": F.col(at), "_kind": F.lit(0), "_anchor": F.lit(None).cast(anchors.schema[anchor_id].dataType)})
    a = anchors.select(*keys, F.col(anchor_at).alias("_t"), F.lit(1).alias("_kind"), F.col(anchor_id).alias("_anchor"))
    both = e.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_kind").desc(), F.col("_anchor").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("following", F.last("_anchor", ignorenulls=True).over(w)).where("_kind = 0").drop("_t", "_kind", "_anchor")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, at: str, right_id: str, right_at: str) -> DataFrame:
    """left_id with the right row of equal keys whose time is nearest, earlier time and smaller id first among equals; rows whose key has none, or with a null key or time, are left out.

    One union and two windows over it, so a key's rows never multiply: the last right row at or before the time, and the first at or after it. Rows that repeat a left_id give one row."""
    r = right.select(*keys, F.col(right_at).alias("_t"), F.struct(F.col(right_at).alias("at"), F.col(right_id).alias("id")).alias("_r"), F.lit(0).alias("_kind"))
    both = left.select(*keys, F.col(left_id), F.col(at).alias("_t"), F.lit(1).alias("_kind")).unionByName(r, allowMissingColumns=True).dropna(subset=[*keys, "_t"])
    n = tasks(both)
    both = both.repartition(n, *keys)
    w, so_far = Window.partitionBy(*keys), (Window.unboundedPreceding, Window.currentRow)
    last_first = F.col("_r.id").desc()  # of equal times, the smallest id is met last
    before = F.last("_r", ignorenulls=True).over(w.orderBy("_t", "_kind", last_first).rowsBetween(*so_far))
    after = F.last("_r", ignorenulls=True).over(w.orderBy(F.col("_t").desc(), "_kind", last_first).rowsBetween(*so_far))
    met = both.withColumns({"_before": before, "_after": after}).where("_kind = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("_t")).alias("delta"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.id").alias("id")))
    best = met.select(left_id, F.least(near("_before"), near("_after")).alias("b")).where("b is not null").repartition(n, left_id).groupBy(left_id).agg(F.min("b").alias("b"))
    return best.select(left_id, F.col("b.id").alias("nearest"), F.col("b.delta").alias("delta_ns"))


def _sweep(batches: Iterator, keys: Sequence[str], id_column: str) -> Iterator:
    """Owned times of intervals that come in order of keys, bin and start; only those that are open are held."""
    import pyarrow as pa

    group, now, open_, owned = None, 0, [], defaultdict(int)

    def forward(until: int | None = None) -> None:
        nonlocal now
        while open_ and (until is None or now < until):
            end = open_[0][-1]
            if end <= now:
                heapq.heappop(open_)
                continue
            stop = end if until is None else min(end, until)
            owned[*group[:-1], open_[0][3]] += stop - now
            now = stop
        now = now if until is None else until

    def rows(kinds: list) -> pa.RecordBatch:
        columns = zip(*((*k, v) for k, v in owned.items())) if owned else [[]] * (len(kinds) + 1)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), [*kinds, pa.int64()])], [*keys, id_column, "owned_ns"])
        owned.clear()
        return out

    kinds = None
    for batch in batches:
        kinds = kinds or [batch.schema.field(c).type for c in (*keys, id_column)]
        for *g, i, p, start, end in zip(*(batch.column(c).to_pylist() for c in (*keys, "_bin", id_column, "_p", "start_ns", "end_ns"))):
            if g != group:
                forward()
                group, now = g, start
            forward(start)
            heapq.heappush(open_, (p is not None, p, i is not None, i, end))
        yield rows(kinds)
    if kinds:
        forward()
        yield rows(kinds)


def ownership(df: DataFrame, keys: Sequence[str], id_column: str, priority: Column, bin_ns: int = HOUR) -> DataFrame:
    """id and owned_ns: each instant belongs to one active interval, that of the highest priority, then of the smallest id. Owned times add up to the union.

    Intervals are clipped to bins first, and a bin is swept in order of time with a heap of the open intervals: n log n, however many are open at once."""
    rows = df.dropna(subset=list(keys)).where("end_ns > start_ns").withColumn("_p", -priority)
    last = F.col("end_ns") - 1
    cut = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_ns") / bin_ns), F.floor(last / bin_ns)))).select(
        *keys, "_bin", id_column, "_p", F.greatest("start_ns", F.col("_bin") * bin_ns).alias("start_ns"), F.least("end_ns", (F.col("_bin") + 1) * bin_ns).alias("end_ns")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*keys, id_column).schema) + ", owned_ns long"
    swept = cut.repartition(*keys, "_bin").sortWithinPartitions(*keys, "_bin", "start_ns").mapInArrow(lambda x: _sweep(x, keys, id_column), schema)
    return swept.groupBy(*keys, id_column).agg(F.sum("owned_ns").alias("owned_ns"))


def gaps(df: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """The silence before each interval that starts beyond all ends before it: keys, id, gap_start, gap_end."""
    prior = _frontier(keys, "end_ns", ("start_ns", "end_ns", id_column))
    return df.withColumn("gap_start", prior).where("start_ns > gap_start").select(*keys, id_column, "gap_start", F.col("start_ns").alias("gap_end"))


def gap_costs(gap: DataFrame, events: DataFrame, keys: Sequence[str], id_column: str, is_comm: Column, is_exec: Column, bin_ns: int = HOUR) -> DataFrame:
    """How each gap is spent: comm_ns where a communication runs, exec_ns where only other work does, idle_ns for waits and silence, and the events met.

    The events are clipped to the gap; communication takes precedence."""
    inside = events.withColumns({"_comm": is_comm, "_exec": is_exec})
    left = gap.select(*keys, F.col(id_column).alias("_gap"), F.col("gap_start").alias("start_ns"), F.col("gap_end").alias("end_ns"))
    met = overlap_join(left, inside.select(*keys, "start_ns", "end_ns", "_comm", "_exec"), keys, bin_ns)
    clip = met.select(*keys, "_gap", "_comm", "_exec", F.greatest("start_ns", "r_start_ns").alias("start_ns"), F.least("end_ns", "r_end_ns").alias("end_ns"))
    comm = busy(clip.where("_comm"), ["_gap"]).select("_gap", F.col("union_ns").alias("comm_ns"))
    active = busy(clip.where("_comm or _exec"), ["_gap"]).select("_gap", F.col("union_ns").alias("active_ns"))
    seen = clip.groupBy("_gap").agg(F.count("*").alias("aux_events"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("aux_ns"))
    out = gap.withColumnRenamed(id_column, "_gap").join(comm, "_gap", "left").join(active, "_gap", "left").join(seen, "_gap", "left").fillna(0, ["comm_ns", "active_ns", "aux_events", "aux_ns"])
    return out.select(*keys, F.col("_gap").alias(id_column), (F.col("gap_end") - F.col("gap_start")).alias("gap_ns"), "comm_ns", (F.col("active_ns") - F.col("comm_ns")).alias("exec_ns"), (F.col("gap_end") - F.col("gap_start") - F.col("active_ns")).alias("idle_ns"), "aux_events", "aux_ns")
