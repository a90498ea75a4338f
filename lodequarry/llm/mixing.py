"""Mixing sources to target weights: budgets by filling up, and subset sums over counts of exact lengths to meet them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequarry.llm import shared

#: Hash buckets by which the ranks of rows of one length are counted before any of them meet in one task.
BUCKETS = 256
#: What is left of a budget is spent length by length until it is at most this, or twice the longest spare length; the exact fit covers all of the rest.
EXACT = 1 << 16


def targets(sizes: list[int], weights: list[int], share: float, most: float) -> list[float]:
    """Targets in proportion to weight that sum to share * all sizes; none above most times its size, the excess reshared by weight."""
    left = share * sum(sizes)
    out = [0.0] * len(sizes)
    free = [k for k, s in enumerate(sizes) if s > 0]
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def subset(parts: list[tuple[int, int, int]], room: int) -> tuple[int, list[tuple[int, int]]]:
    """The largest sum of parts (name, number, length of one) that is at most room, and the (name, number) of the parts used.

    The sums reached are bits of one integer; what was reached before each part is kept, room / 8 bytes, until room itself is reached."""
    bits, mask, before = 1, (1 << room + 1) - 1, []
    for name, n, length in parts:
        if bits >> room & 1:
            break
        before.append((bits, name, n, n * length))
        bits |= (bits << n * length) & mask
    best = at = bits.bit_length() - 1
    used = []
    for was, name, n, weight in reversed(before):
        if not was >> at & 1:
            used.append((name, n))
            at -= weight
    return best, used


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many rows of each length to take so that their lengths sum to the budget, or come as near below it as any choice of rows can.

    Each length gives the same share of its rows, rounded down; what is left of the budget is spent by one row a length, largest remainders first (ties by
    a seeded number), until it is at most EXACT or twice the longest spare length, and the rest by bounded-knapsack dynamic programming over what remains of each length.
    Where that doesn't meet the budget (or the next multiple of the lengths' common divisor below it), every length gives back one of its rows, then 3, 7 and so on, to a
    larger program, until the budget is met or all rows are in the program."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    some = np.flatnonzero((lengths > 0) & (counts > 0))
    step = math.gcd(*lengths[some].tolist())
    goal = budget // step * step
    base = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    spare = counts - base
    rest = budget - int((lengths * base).sum())
    bound = max(EXACT, 2 * int(lengths[spare > 0].max(initial=0)))
    remainder = np.array([int(c) * budget % total / total for c in counts.tolist()])
    turns = np.lexsort((np.random.default_rng(17).random(len(lengths)), -remainder))
    while rest > bound:  # no length is over half the bound, so each fits
        for k in turns[(spare[turns] > 0) & (lengths[turns] > 0)]:
            if rest <= bound:
                break
            base[k] += 1
            spare[k] -= 1
            rest -= int(lengths[k])
    order = some[np.argsort(-lengths[some])].tolist()
    give = 0
    while True:
        back = np.minimum(base, give)
        back[lengths == 0] = 0
        take, room = base - back, goal - int((lengths * (base - back)).sum())
        parts = []
        for k in order:
            left, power = min(int(spare[k] + back[k]), room // int(lengths[k])), 1
            while left > 0:  # binary parts of the count
                n = min(power, left)
                parts.append((k, n, int(lengths[k])))
                left, power = left - n, 2 * power
        best, used = subset(parts, room)
        if best == room or (back[some] == base[some]).all():
            for k, n in used:
                take[k] += n
            return take
        give = 2 * give + 1


def _fit_source(pdf):
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    target, total = float(pdf["target"].iloc[0]), int((lengths * counts).sum())
    budget = int(round(target))
    rounds, rest = divmod(budget, total) if total else (0, 0)
    pdf["whole"] = rounds
    pdf["more"] = fit(lengths, counts, rest)
    return pdf[["source", "size", "whole", "more"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """All rows and columns of docs with size, source_size, target, copies and taken: how often the mix takes each document, and its words.

    Size is the number of words of the text (null: 0). Sources in order of their code points, null last (a source of its own), take the weights in
    turn; targets sum to `share` of all sizes, none above `most` times its source's size. A source's documents are all taken as often as the target
    covers; of the rest, counts of exact lengths are fitted to the remaining budget and that many documents of each length taken
    once more, in the order of a seeded hash of id and text; rows alike in both are alike in rank up to their place, which changes nothing in the
    result as a multiset. No choice of rows comes nearer to the (rounded) target from below; mostly it is met. Columns of docs of these names
    are replaced. An empty table gives an empty result. The driver holds a row per source; a task a row per length of a source.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumns({
        "size": F.coalesce(F.regexp_count(F.col(text_column), F.lit(shared.WORD)), F.lit(0)).cast("long"),
        "lq_hash": F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)),
    })
    slim = shared.staged(sized.select(F.col(source_column).alias("source"), "size", F.col("lq_hash").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-counts")
    sources = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["source_size"] for r in sources], [weights[k % len(weights)] for k in range(len(sources))], share, float(most))
    kind = slim.schema["source"].dataType.simpleString()
    plan = F.broadcast(spark.createDataFrame([(r["source"], r["source_size"], t) for r, t in zip(sources, goal)], f"source {kind}, source_size long, target double"))  # a row per source
    lengths = slim.groupBy("source", "size").agg(F.sum("n").alias("n"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    fitted = lengths.join(plan, same(lengths, plan)).select(lengths["source"], "size", "n", "target").groupBy("source").applyInPandas(_fit_source, f"source {kind}, size long, whole long, more long")
    fitted = shared.staged(fitted, "mix-fitted")
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = slim.withColumn("lq_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    f = fitted.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "whole", "more")
    based = based.join(f, based["source"].eqNullSafe(f["f_source"]) & (based["size"] == f["f_size"])).select(
        F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "n", "lq_base", "whole", "more"
    )
    # a bucket lies before the cut, after it, or across it; rows are ranked only where it lies across
    sized = sized.withColumn("lq_bucket", F.col("lq_hash").bitwiseAND(BUCKETS - 1).cast("int"))
    met = sized.join(based, F.col(source_column).eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("lq_bucket") == F.col("b_bucket")))
    rank = F.row_number().over(Window.partitionBy(source_column, "size", "lq_bucket").orderBy("lq_hash", id_column)) - 1
    copies = F.col("whole") + (F.col("lq_base") + rank < F.col("more")).cast("long")
    met = met.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    out = met.join(plan.withColumnRenamed("source", "p_source"), F.col(source_column).eqNullSafe(F.col("p_source")))
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")
