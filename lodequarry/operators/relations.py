"""Relations between host calls and device work, and between neighbouring anchors and host windows."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequarry.operators.intervals import containment_join


def correlated(calls: DataFrame, work: DataFrame, call_id: str = "call_id", work_id: str = "work_id", key: str = "correlation_id") -> DataFrame:
    """Every call and every unit of work with its partners by key, as typed rows: call_id, work_id, cardinality, support_state.

    one_to_one and one_to_many are supported; several calls of one key are ambiguous (rejected_reused_correlation_id); rows without a key or without a partner stay, as
    missing_runtime_identifier, missing_device_identifier, unmatched_call or unmatched_work. Counts are taken before the join, so reused
    keys with very many rows on both sides never multiply: they give a row for each call and each unit of work."""
    n_calls = calls.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_calls"), F.min(call_id).alias("only_call"))
    n_work = work.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_work"))
    keys = n_calls.join(n_work, key, "full")
    c = calls.select(key, F.col(call_id).alias("c")).join(keys.select(key, "n_calls", "n_work"), key, "left")
    w = work.select(key, F.col(work_id).alias("w")).join(keys, key, "left")
    call_rows = c.where(F.col(key).isNull() | F.col("n_work").isNull() | (F.col("n_calls") > 1)).select(
        F.col("c").alias("call_id"),
        F.lit(None).cast(w.schema["w"].dataType).alias("work_id"),
        F.when(F.col(key).isNull() | F.col("n_work").isNull(), "one_to_none").otherwise("many_to_many").alias("cardinality"),
        F.when(F.col(key).isNull(), "missing_runtime_identifier").when(F.col("n_work").isNull(), "unmatched_call").otherwise("rejected_reused_correlation_id").alias("support_state"),
    )
    single = F.col("n_calls") == 1
    work_rows = w.select(
        F.when(single, F.col("only_call")).alias("call_id"),
        F.col("w").alias("work_id"),
        F.when(F.col(key).isNull() | F.col("n_calls").isNull(), "none_to_one").when(~single, "many_to_many").when(F.col("n_work") == 1, "one_to_one").otherwise("one_to_many").alias("cardinality"),
        F.when(F.col(key).isNull(), "missing_device_identifier").when(F.col("n_calls").isNull(), "unmatched_work").when(~single, "rejected_reused_correlation_id").when(F.col("n_work") == 1, "supported_exact").otherwise("supported_deterministic").alias("support_state"),
    )
    return call_rows.unionByName(work_rows)


def contained_once(calls: DataFrame, work: DataFrame, key: str) -> DataFrame:
    """For keys that several calls reuse: work with the one call of its key that contains it in time; ambiguous if several do, unmatched if none does (or the key is null).

    Containment is looked up by time bins, so that work meets only the calls around it."""
    inside = containment_join(calls.select(key, "call_id", "start_ns", "end_ns"), work.select(key, "work_id", "start_ns", "end_ns"), [key])
    by = inside.groupBy("work_id").agg(F.count("*").alias("n"), F.min("call_id").alias("one"))
    met = work.select("work_id").distinct().join(by, "work_id", "left")
    return met.select("work_id", F.when(F.col("n") == 1, F.col("one")).alias("call_id"), F.when(F.col("n") == 1, "supported_deterministic").when(F.col("n") > 1, "ambiguous_runtime_scope").otherwise("unmatched_work").alias("support_state"))


def host_intervals(anchors: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The host window between each anchor (anchor_id, call_end, process_id, thread_id; nulls where no call is known) and the one before it.

    scope_policy narrows with what both ends share; support_state is supported_ordered only if both calls are known and in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prior = lambda c: F.lag(c).over(w)
    pair = anchors.select(
        *keys, prior("anchor_id").alias("left_anchor_id"), F.col("anchor_id").alias("right_anchor_id"), prior("call_end").alias("host_start_ns"), F.col("call_start").alias("host_end_ns"),
        (prior("process_id") == F.col("process_id")).alias("same_process"), (prior("thread_id") == F.col("thread_id")).alias("same_thread"), "process_id", "thread_id",
    ).where("left_anchor_id is not null")
    known = F.col("host_start_ns").isNotNull() & F.col("host_end_ns").isNotNull()
    return pair.select(
        *keys, "left_anchor_id", "right_anchor_id", "host_start_ns", "host_end_ns", "process_id", "thread_id",
        F.when(F.col("same_process") & F.col("same_thread"), "same_thread").when(F.col("same_process"), "same_process").otherwise("any").alias("scope_policy"),
        F.when(~known, "missing_endpoint").when(F.col("host_end_ns") < F.col("host_start_ns"), "nonmonotonic_host_order").otherwise("supported_ordered").alias("support_state"),
    )


def in_scope(policy: str = "scope_policy", process: str = "process_id", thread: str = "thread_id", other: str = "r_") -> Column:
    """Whether a call seen in a host window is one that the window's policy admits; the call's columns carry a prefix."""
    p, t = F.col(process) == F.col(other + process), F.col(thread) == F.col(other + thread)
    return (F.col(policy) == "any") | ((F.col(policy) == "same_process") & p) | ((F.col(policy) == "same_thread") & p & t)


def greedy_pairs(candidates: DataFrame, group: Sequence[str], left: str, right: str, cost: str) -> DataFrame:
    """Of candidate pairs in each group, those that a greedy matching takes: cheapest first, then smaller left, then smaller right, each id once."""
    import pandas as pd

    schema = candidates.select(*group, left, right, cost).schema

    def match(pdf):
        used_l, used_r, out = set(), set(), []
        for row in pdf.sort_values([cost, left, right]).itertuples(index=False):
            a, b = getattr(row, left), getattr(row, right)
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                out.append(row)
        return pd.DataFrame(out, columns=pdf.columns)

    return candidates.select(*schema.names).groupBy(*group).applyInPandas(match, schema)


def nearest_first(start: Sequence[int], end: Sequence[int], code: Sequence[int], is_left: Sequence[bool]) -> list[tuple[int, int]]:
    """greedy_pairs() of the overlapping intervals of two sides, by the distance of their starts, without the pairs: places of (left, right) pairs taken.

    Rows come in order of start, side and id; `code` numbers the ids of each side in their order, and a code is taken once. Of a pair, the earlier row keeps the next row of the other side that is
    not taken; a heap holds one candidate a row, and a row whose candidate was taken moves on to the next."""
    n = len(start)
    taken: tuple[set, set] = (set(), set())
    ahead = ([*range(1, n + 1)], [*range(1, n + 1)])  # by side, the next place that may be of the other side and free

    def free(k: int, side: int) -> bool:
        return is_left[k] != side and code[k] not in taken[1 - side]

    def following(k: int, side: int) -> int:
        """The first free place of the other side behind k; the way is shortened for the next one who goes it."""
        up, at = ahead[side], k
        while (at := up[at]) < n and not free(at, side):
            pass
        while k < n and up[k] < at:
            up[k], k = at, up[k]
        return at

    def offer(a: int, b: int) -> None:
        side = int(is_left[a])
        while (b := following(b, side)) < n and start[b] < end[a]:
            if end[b] > start[a]:
                l, r = (a, b) if side else (b, a)
                heapq.heappush(heap, (start[b] - start[a], code[l], code[r], a, b))
                return

    heap: list[tuple[int, int, int, int, int]] = []
    for a in range(n):
        offer(a, a)
    out = []
    while heap:
        _, l, r, a, b = heapq.heappop(heap)
        side = int(is_left[a])
        if code[a] in taken[side]:
            continue
        if code[b] in taken[1 - side]:
            offer(a, b)
            continue
        taken[1].add(l)
        taken[0].add(r)
        out.append((a, b) if side else (b, a))
    return out


def claimed(left: DataFrame, right: DataFrame, group: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """greedy_pairs() of the pairs of overlapping intervals (start_ns, end_ns) with equal keys, by the distance of their starts (delta), in memory that grows with the rows of a group."""
    import numpy as np
    import pandas as pd

    side = lambda df, c, left: df.select(*group, F.col(c).alias("_id"), "start_ns", "end_ns", F.lit(left).alias("_left")).dropna()
    both = side(left, left_id, True).unionByName(side(right, right_id, False))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}

    def match(pdf):
        pdf = pdf.sort_values(["start_ns", "_left", "_id"])
        is_left, ids = pdf["_left"].to_numpy(), pdf["_id"].to_numpy()
        code = np.zeros(len(pdf), np.int64)
        for x in (True, False):
            code[is_left == x] = np.unique(ids[is_left == x], return_inverse=True)[1]
        at = pdf["start_ns"].to_numpy()
        pairs = np.array(nearest_first(at.tolist(), pdf["end_ns"].tolist(), code.tolist(), is_left.tolist()), np.int64).reshape(-1, 2)
        out = {c: np.full(len(pairs), pdf[c].iloc[0]) for c in group}
        return pd.DataFrame(out | {left_id: ids[pairs[:, 0]], right_id: ids[pairs[:, 1]], "delta": np.abs(at[pairs[:, 1]] - at[pairs[:, 0]])})

    return both.groupBy(*group).applyInPandas(match, ", ".join(f"`{c}` {kinds[c]}" for c in group) + f", `{left_id}` {kinds['_id']}, `{right_id}` {kinds['_id']}, delta long")


def ordinal_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, a_order: Sequence[str], b_id: str, b_order: Sequence[str]) -> DataFrame:
    """Pairs of the k-th of a and the k-th of b in groups where both have equally many."""
    w = lambda order: Window.partitionBy(*keys).orderBy(*order)
    n = lambda df, i, order, name: df.select(*keys, F.col(i).alias(name), F.row_number().over(w(order)).alias("_k"), F.count("*").over(Window.partitionBy(*keys)).alias(f"_n_{name}"))
    met = n(a, a_id, a_order, "left_id").join(n(b, b_id, b_order, "right_id"), [*keys, "_k"])
    return met.where("_n_left_id = _n_right_id").select(*keys, F.col("_k").alias("ordinal"), "left_id", "right_id")


def activities(calls: DataFrame, keys: Sequence[str], order: Sequence[str], is_launch: Column, is_sync: Column) -> DataFrame:
    """Launches of a thread grouped by the synchronisation that closes them: keys, activity (from 0), launches, first and last start, closed_by_sync.

    A synchronisation with no launch before it closes nothing; launches behind the last one are a tail that nothing closes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = calls.withColumns({"_l": is_launch, "_s": is_sync}).where("_l or _s")
    seat = F.coalesce(F.sum(F.col("_s").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = flagged.withColumn("_g", seat).groupBy(*keys, "_g").agg(F.count_if("_l").alias("launches"), F.min(F.when(F.col("_l"), F.col("start_ns"))).alias("first_start_ns"), F.max(F.when(F.col("_l"), F.col("start_ns"))).alias("last_start_ns"), F.max("_s").alias("closed_by_sync"))
    again = Window.partitionBy(*keys).orderBy("_g")
    return groups.where("launches > 0").withColumn("activity", F.row_number().over(again) - 1).drop("_g")


def capture_intervals(markers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals from the k-th begin to the k-th end marker (kind, at_ns) of each key, where the end comes later: keys, slot, start_ns, end_ns."""
    begin = markers.where("kind = 'begin'").select(*keys, F.col("at_ns").alias("b"))
    end = markers.where("kind = 'end'").select(*keys, F.col("at_ns").alias("e"))
    w = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c))
    met = begin.withColumn("slot", w("b") - 1).join(end.withColumn("slot", w("e") - 1), [*keys, "slot"])
    return met.where("e > b").select(*keys, "slot", F.col("b").alias("start_ns"), F.col("e").alias("end_ns"))


def signatures(members: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str) -> DataFrame:
    """By key, its members' symbols in order as one signature, its SHA-256, and the number of the template that keys of one signature share (by signature)."""
    listed = members.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(symbol).alias("_s")))).alias("x"))
    signed = listed.select(*keys, F.array_join(F.transform("x", lambda y: y["_s"]), ">").alias("signature"), F.size("x").alias("members"))
    names = signed.select("signature").distinct()
    numbered = names.withColumn("template", F.sha2("signature", 256))
    return signed.join(numbered, "signature").select(*keys, "signature", "members", "template")
