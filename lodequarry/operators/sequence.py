"""Symbol sequences: runs, n-grams with boundaries, motifs, periodic suffixes, and a grammar of runs and pairs.

Runs and n-grams are windows. What depends on its own earlier steps (grammar, suffix) is a function of one ordered sequence, run per group.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task should sort, and those of one cell of a split sequence.
_TASK, _CELL = 1_000_000, 200_000


def _cells(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """df dealt out by keys and `_cell`, a stretch of the first order column that rises with it, and the number of tasks: long sequences are sorted by many tasks.

    One scan finds the column's bounds; a column that is no integer gives one cell."""
    c, kind = order[0], df.schema[order[0]].dataType.simpleString()
    n, low, high = df.agg(F.count("*"), F.min(c), F.max(c)).first()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // _TASK))
    cell = F.lit(0).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint") and low is not None:
        width = (high - low) // -(-n // _CELL) + 1
        cell = F.coalesce(F.expr(f"(CAST(`{c}` AS BIGINT) - {low}L) div {width}L"), F.lit(-1).cast("long"))  # nulls come first in order
    return df.withColumn("_cell", cell).repartition(tasks, *keys, "_cell"), tasks


def _with(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """df joined to a small table, also where keys are null."""
    other = F.broadcast(small.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in small.columns if c not in on)))
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return df.join(other, same, how).drop(*(f"_on_{c}" for c in on))


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df (with `_cell`) with the sum of value over the rows before, by keys: sums within a cell, and of the cells before, of which there is a row each."""
    before = (Window.unboundedPreceding, -1)
    local = df.withColumn(name, F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(*before)), F.lit(0)))
    sums = df.groupBy(*keys, "_cell").agg(F.sum(value).alias("_v"))
    sums = sums.select(*keys, "_cell", F.coalesce(F.sum("_v").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(*before)), F.lit(0)).alias("_before"))
    return _with(local, sums, [*keys, "_cell"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str) -> DataFrame:
    """Maximal runs of equal neighbouring symbols: keys, run (from 0), symbol, first_pos, last_pos, length; positions count from 0."""
    return _local_runs(df, keys, order, symbol).groupBy(*keys, "run").agg(F.first(symbol).alias("symbol"), F.min("_pos").alias("first_pos"), F.max("_pos").alias("last_pos"), F.count("*").alias("length"))


def _local_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(symbol).over(w).eqNullSafe(F.col(symbol)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumns({"_pos": F.row_number().over(w) - 1, "_change": change})
    return marked.withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def long_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str) -> DataFrame:
    """runs() for few and long sequences, in many tasks: runs of each cell, which are joined where they meet. A row per key and cell is broadcast."""
    dealt, tasks = _cells(df.select(*keys, *(c for c in order if c not in keys), *([] if symbol in (*keys, *order) else [symbol])), keys, order)
    piece = _local_runs(dealt, [*keys, "_cell"], order, symbol).groupBy(*keys, "_cell", "run").agg(F.first(symbol).alias("symbol"), F.min("_pos").alias("first_pos"), F.count("*").alias("length"))
    cell = piece.groupBy(*keys, "_cell").agg(F.sum("length").alias("_rows"), F.count("*").alias("_runs"), F.min_by("symbol", "run").alias("_first"), F.max_by("symbol", "run").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    meets = F.when((F.row_number().over(w) > 1) & F.lag("_last").over(w).eqNullSafe(F.col("_first")), 1).otherwise(0)
    cell = cell.withColumn("_meets", meets).select(*keys, "_cell", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r"), (F.coalesce(F.sum("_runs").over(before), F.lit(0)) - F.sum("_meets").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("_n"))
    placed = _with(piece, cell, [*keys, "_cell"]).select(*keys, (F.col("run") + F.col("_n")).alias("run"), "symbol", (F.col("first_pos") + F.col("_r")).alias("first_pos"), "length")
    whole = placed.repartition(tasks, *keys, "run").groupBy(*keys, "run").agg(F.first("symbol").alias("symbol"), F.min("first_pos").alias("first_pos"), F.sum("length").alias("length"))
    return whole.select(*keys, "run", "symbol", "first_pos", (F.col("first_pos") + F.col("length") - 1).alias("last_pos"), "length")


def ngrams(df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str, shortest: int, longest: int) -> DataFrame:
    """All occurrences of symbol n-grams of these lengths: keys, first_pos, last_pos, length, gram (joined by >).

    Rows get their positions by cells; blocks of positions, which also hold the first rows of the block behind, are tasks of their own."""
    size = max(_CELL, longest)
    dealt, tasks = _cells(df.select(*keys, *(c for c in order if c not in keys), *([] if symbol in (*keys, *order) else [symbol])), keys, order)
    at = _running(dealt, keys, order, F.lit(1), "first_pos").select(*keys, "first_pos", F.col(symbol).alias("_s"))
    home = F.expr(f"first_pos div {size}")
    shared = (home > 0) & (F.col("first_pos") % size < longest - 1)
    at = at.withColumn("_block", F.explode(F.when(shared, F.array(home, home - 1)).otherwise(F.array(home)))).repartition(tasks, *keys, "_block")
    ahead = F.collect_list("_s").over(Window.partitionBy(*keys, "_block").orderBy("first_pos").rowsBetween(0, longest - 1))
    rows = at.select(*keys, "first_pos", "_block", ahead.alias("_ahead")).where(home == F.col("_block"))
    each = rows.withColumn("length", F.explode(F.filter(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: n <= F.size("_ahead"))))
    return each.select(*keys, "first_pos", (F.col("first_pos") + F.col("length") - 1).alias("last_pos"), "length", F.array_join(F.slice("_ahead", 1, F.col("length")), ">").alias("gram"))


def violations(grams: DataFrame, intervals: DataFrame, keys: Sequence[str], width: int = 256) -> DataFrame:
    """grams with `violates`: the first protected interval (interval_id, first_token, last_token, policy) that an occurrence breaks, null if none.

    no_cross: an occurrence may lie inside or outside, not cut or enclose; allow_enclosing: it may enclose as well; block_any_overlap: it must not overlap at all.
    Occurrences meet only the intervals that touch one of their stretches of `width` positions; those of one stretch that meet none are not grouped."""
    stretch = lambda first, last: F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width)))
    i = intervals.select(*keys, "interval_id", "first_token", "last_token", "policy").where("first_token <= last_token").withColumn("_bin", stretch("first_token", "last_token"))
    met = grams.withColumn("_bin", stretch("first_pos", "last_pos")).join(i, [*keys, "_bin"], "left")
    a, b, s, e = (F.col(c) for c in ("first_pos", "last_pos", "first_token", "last_token"))
    overlap = (a <= e) & (b >= s)
    inside, around = (a >= s) & (b <= e), (a <= s) & (b >= e)
    bad = overlap & F.when(F.col("policy") == "block_any_overlap", F.lit(True)).when(F.col("policy") == "allow_enclosing", ~inside & ~around).otherwise(~inside)
    first = F.min(F.when(bad, F.struct("first_token", "interval_id")))
    free = F.col("interval_id").isNull() & (F.floor(F.col("first_pos") / width) == F.floor(F.col("last_pos") / width))
    broken = met.where(~free).groupBy(*[c for c in grams.columns]).agg(first.alias("_v")).select(*grams.columns, F.col("_v.interval_id").alias("violates"))
    return broken.unionByName(met.where(free).select(*grams.columns, F.col("interval_id").alias("violates")))


def unblocked(grams: DataFrame, blocked: DataFrame, gram: str = "gram") -> DataFrame:
    """Occurrences whose gram never occurs among the blocked ones."""
    return grams.join(blocked.select(gram).distinct(), gram, "left_anti")


def primitive(tokens: Sequence) -> list:
    """The shortest motif that, repeated whole, is the sequence."""
    n = len(tokens)
    for p in range(1, n + 1):
        if n % p == 0 and all(tokens[k] == tokens[k - p] for k in range(p, n)):
            return list(tokens[:p])
    return []


def periodic_suffix(ids: Sequence, least: int = 2) -> tuple[int, int, int, int] | None:
    """(start, period, full repeats, rest) of the longest suffix that repeats a period at least `least` times; more repeats and then the shorter period
    win among equal starts."""
    n, best = len(ids), None
    if least < 2:
        return None
    alike = _prefixes(ids[::-1])  # how far the sequence, read from its end, equals itself a period later
    for p in range(1, n // least + 1):
        length = alike[p] + p
        repeats, rest = divmod(length, p)
        if repeats >= least:
            key = (length, repeats, -p)
            if best is None or key > best[0]:
                best = (key, (n - length, p, repeats, rest))
    return best and best[1]


def _prefixes(ids: Sequence) -> list[int]:
    """For each place, how many ids from there equal those from the start; in linear time, as what is known of the furthest match is used again."""
    n = len(ids)
    out = [n] * (n > 0) + [0] * (n - 1)
    begin = end = 0
    for k in range(1, n):
        m = min(end - k, out[k - begin]) if k < end else 0
        while k + m < n and ids[m] == ids[k + m]:
            m += 1
        out[k] = m
        if k + m > end:
            begin, end = k, k + m
    return out


@dataclass
class Macro:
    """A symbol that stands for others: a run of one symbol or a pair."""

    name: str
    kind: str  # "run" or "pair"
    parts: tuple[str, ...]
    times: int
    is_loop: bool


@dataclass
class Grammar:
    """What is left of a sequence after folding, and the macros it uses."""

    nodes: list[tuple[str, int, int]]  # symbol, first and last position
    macros: dict[str, Macro] = field(default_factory=dict)
    steps: list[tuple[str, str, int]] = field(default_factory=list)  # stage, new symbol, replacements
    status: str = "done"


def grammar(symbols: Sequence[str], cap: int = 50_000, most_rounds: int = 100_000, allowed: Callable[[int, int], bool] = lambda first, last: True) -> Grammar:
    """Fold a sequence: first runs of equal symbols, then again and again the most frequent pair of unlike neighbours and runs of the macros that arise.

    A round replaces one key everywhere. Runs are keyed by symbol and exact length, the largest saving first (ties: longer, more frequent, earlier, smaller
    symbol); pairs by frequency (ties: earlier, smaller); macro runs by symbol over all lengths, if they save more than one node. Pairs that touch share no node:
    the earlier one is replaced. `allowed` tells whether positions from first to last may become one node. Sequences of over `cap` nodes after the first
    folding are left there; `most_rounds` bounds the whole.

    The rounds are those of a scan after each replacement, but only what a replacement touches is counted anew: nodes form a linked list, and pairs keep where
    they stand. A macro's run can only arise when the macro does, so runs are looked for among its own nodes."""
    return grammar_of_runs([(s, sum(1 for _ in g)) for s, g in itertools.groupby(symbols)], cap, most_rounds, allowed)


def grammar_of_runs(lengths: Iterable[tuple[str, int]], cap: int = 50_000, most_rounds: int = 100_000, allowed: Callable[[int, int], bool] = lambda first, last: True) -> Grammar:
    """grammar() of a sequence given as its maximal runs: symbol and length."""
    g = Grammar([])
    rounds = fresh = 0
    # runs of the sequence itself: the runs of one symbol never touch, so one scan finds all keys
    nodes: list[tuple[str, int, int]] = []
    by: dict[tuple[str, int], list[int]] = defaultdict(list)
    k = 0
    for symbol, n in lengths:
        e = k + n
        if n >= 2 and allowed(k, e - 1):
            by[symbol, n].append(len(nodes))
            nodes.append((symbol, k, e - 1))
        else:
            nodes.extend((symbol, j, j) for j in range(k, e))
        k = e
    order = sorted(by, key=lambda x: (-len(by[x]) * (x[1] - 1), -x[1], -len(by[x]), nodes[by[x][0]][1], x[0]))
    if len(order) + 1 > most_rounds:
        order, g.status = order[:most_rounds], "round_limit_exceeded"
    named: set[int] = set()
    for symbol, n in order:
        fresh += 1
        name = f"M{fresh}"
        g.macros[name] = Macro(name, "run", (symbol,), n, True)
        g.steps.append(("run_fold", name, len(by[symbol, n])))
        for at in by[symbol, n]:
            nodes[at] = (name, *nodes[at][1:])
            named.add(at)
    if g.status != "done":
        left = {at for x in by for at in by[x]} - named
        g.nodes = [y for at, x in enumerate(nodes) for y in ([(x[0], j, j) for j in range(x[1], x[2] + 1)] if at in left else [x])]
        return g
    rounds = len(order) + 1
    if len(nodes) > cap:
        g.nodes, g.status = nodes, "sequence_too_large_for_full_pair_discovery"
        return g

    size = len(nodes)
    sym, first, last = [x[0] for x in nodes], [x[1] for x in nodes], [x[2] for x in nodes]
    nxt, prv = [*range(1, size), -1] if size else [], list(range(-1, size - 1))
    places: dict[tuple[str, str], set[int]] = defaultdict(set)
    heaps: dict[tuple[str, str], list[int]] = defaultdict(list)
    queue: list[tuple[int, int, tuple[str, str]]] = []

    def earliest(pair: tuple[str, str]) -> int:
        h, have = heaps[pair], places[pair]
        while h[0] not in have:
            heapq.heappop(h)
        return h[0]

    def offer(pair: tuple[str, str]) -> None:
        n = len(places[pair])
        if n >= 2:
            heapq.heappush(queue, (-n, first[earliest(pair)], pair))

    def put(i: int) -> None:
        j = nxt[i]
        if j >= 0 and sym[i] != sym[j] and allowed(first[i], last[j]):
            pair = sym[i], sym[j]
            places[pair].add(i)
            heapq.heappush(heaps[pair], i)
            touched.add(pair)

    def drop(i: int) -> None:
        if i >= 0 and nxt[i] >= 0:
            pair = sym[i], sym[nxt[i]]
            if i in places.get(pair, ()):
                places[pair].discard(i)
                touched.add(pair)

    def merge(i: int, j: int, name: str) -> None:
        """Nodes i to j become one, at i."""
        end = nxt[j]
        drop(prv[i])
        at = i
        while at != end:
            drop(at)
            at = nxt[at]
        sym[i], last[i], nxt[i] = name, last[j], end
        if end >= 0:
            prv[end] = i
        if prv[i] >= 0:
            put(prv[i])
        put(i)

    touched: set[tuple[str, str]] = set()
    for i in range(size):
        put(i)
    for pair in touched:
        offer(pair)
    while True:
        rounds += 1
        if rounds > most_rounds:
            g.status = "round_limit_exceeded"
            break
        pair = None
        while queue:
            n, at, pair = heapq.heappop(queue)
            if len(places[pair]) == -n and first[earliest(pair)] == at:
                break
            pair = None
        if pair is None:
            break
        touched.clear()
        fresh += 1
        name = f"M{fresh}"
        g.macros[name] = Macro(name, "pair", pair, 1, False)
        spots = sorted(places[pair])
        for i in spots:
            merge(i, nxt[i], name)
        g.steps.append(("pair_grammar", name, len(spots)))
        runs_, k = [], 0
        while k < len(spots):
            e = k
            while e + 1 < len(spots) and nxt[spots[e]] == spots[e + 1]:
                e += 1
            if e > k and allowed(first[spots[k]], last[spots[e]]):
                runs_.append((spots[k], spots[e], e - k + 1))
            k = e + 1
        rounds += 1
        if rounds <= most_rounds and sum(n - 1 for _, _, n in runs_) > 1:
            names = {}
            for n in sorted({n for _, _, n in runs_}):
                fresh += 1
                names[n] = f"M{fresh}"
                g.macros[names[n]] = Macro(names[n], "run", (name,), n, True)
            for i, j, n in runs_:
                merge(i, j, names[n])
            g.steps.append(("macro_run_fold", "+".join(names.values()), len(runs_)))
            rounds += 1
        for p in touched:
            offer(p)
        if rounds > most_rounds:
            g.status = "round_limit_exceeded"
            break
    i = 0 if size else -1
    while i >= 0:
        g.nodes.append((sym[i], first[i], last[i]))
        i = nxt[i]
    return g


def expand(g: Grammar, symbol: str) -> list[str]:
    """The symbols of the sequence that a symbol stands for."""
    out, stack = [], [symbol]
    while stack:
        s = stack.pop()
        m = g.macros.get(s)
        if m is None:
            out.append(s)
        else:
            stack.extend(list(m.parts)[::-1] if m.kind == "pair" else list(m.parts) * m.times)
    return out


def tree(g: Grammar) -> list[tuple[int, int | None, str, str, int, int, int]]:
    """The folded sequence as a tree: node, parent, kind (root, repeat, sequence or atom), symbol, repeats, first and last position; in depth-first order.

    A run is a repeat node whose children are its times; a pair is inlined into the node around it unless it stands alone in a repeat, where it is a sequence."""
    rows: list[tuple[int, int | None, str, str, int, int, int]] = []

    def put(parent: int | None, kind: str, symbol: str, times: int, a: int, b: int) -> int:
        rows.append((len(rows), parent, kind, symbol, times, a, b))
        return len(rows) - 1

    sizes: dict[str, int] = {}

    def size(s: str) -> int:
        if s not in sizes:
            m = g.macros.get(s)
            sizes[s] = 1 if m is None else sum(map(size, m.parts)) * m.times
        return sizes[s]

    for name in g.macros:  # in order of their making, so that parts are known
        size(name)
    root = put(None, "root", "", 1, 0, max(0, len(g.nodes) and g.nodes[-1][2]))
    stack = [(root, s, a) for s, a, _ in reversed(g.nodes)]
    while stack:
        parent, s, a = stack.pop()
        if s.startswith("\0"):  # one time of a repeated pair
            s = s[1:]
            parent = put(parent, "sequence", s, 1, a, a + size(s) - 1)
        m = g.macros.get(s)
        if m is None:
            put(parent, "atom", s, 1, a, a)
        elif m.kind == "pair":
            stack.append((parent, m.parts[1], a + size(m.parts[0])))
            stack.append((parent, m.parts[0], a))
        else:
            me = put(parent, "repeat", m.parts[0], m.times, a, a + size(s) - 1)
            inner, step = g.macros.get(m.parts[0]), size(m.parts[0])
            for k in reversed(range(m.times)):
                if inner is None or inner.kind == "run":
                    stack.append((me, m.parts[0], a + k * step))
                else:
                    stack.append((me, "\0" + m.parts[0], a + k * step))
    return rows


def _split(df: DataFrame, key: str, order: Sequence[str], symbol: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """The runs of sequences that grammar() folds on, and of those that it leaves after their runs, as they exceed `cap` nodes; the latter with the `_name` of their run's macro.

    Counts of runs by symbol and length tell which is which, and number the macros as grammar() does. Sequences with too many macros for its rounds are among the former."""
    run = long_runs(df, [key], order, symbol)
    kinds = run.groupBy(key, "symbol", "length").agg(F.count("*").alias("_n"), F.min("first_pos").alias("_at"))
    all_, many = Window.partitionBy(key), F.col("length") >= 2
    rank = F.row_number().over(all_.orderBy(~many, -F.col("_n") * (F.col("length") - 1), F.desc("length"), F.desc("_n"), "_at", "symbol"))
    kinds = kinds.withColumns({"_name": F.when(many, F.concat(F.lit("M"), rank)).otherwise(F.col("symbol")), "_left": (F.sum("_n").over(all_) > cap) & (F.count_if(many).over(all_) < 100_000)})
    named = kinds.select(F.col(key).alias("_k"), F.col("symbol").alias("_s"), F.col("length").alias("_l"), "_name", "_left")
    met = run.join(named, F.col(key).eqNullSafe(F.col("_k")) & F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("length") == F.col("_l"))).drop("_k", "_s", "_l")
    return met.where(~F.col("_left")).select(key, "run", "symbol", "length"), met.where("_left")


def folded(df: DataFrame, key: str, order: Sequence[str], symbol: str, cap: int = 50_000) -> DataFrame:
    """By key, the nodes of the folded sequence: key, node (from 0), symbol, first_pos, last_pos, expansion, status.

    One task folds one sequence of at most `cap` runs; longer ones are left after their runs, which many tasks find."""
    import pandas as pd

    kind = df.schema[key].dataType.simpleString()

    def fold(pdf):
        pdf = pdf.sort_values("run")
        g = grammar_of_runs(zip(pdf["symbol"].tolist(), pdf["length"].tolist()), cap)
        rows = [(pdf[key].iloc[0], k, s, a, b, ">".join(expand(g, s)), g.status) for k, (s, a, b) in enumerate(g.nodes)]
        return pd.DataFrame(rows, columns=[key, "node", "symbol", "first_pos", "last_pos", "expansion", "status"])

    short, long = _split(df, key, order, symbol, cap)
    done = short.groupBy(key).applyInPandas(fold, f"`{key}` {kind}, node int, symbol string, first_pos int, last_pos int, expansion string, status string")
    text = F.array_join(F.array_repeat("symbol", F.col("length").cast("int")), ">")
    left = long.select(key, F.col("run").cast("int").alias("node"), F.col("_name").alias("symbol"), F.col("first_pos").cast("int"), F.col("last_pos").cast("int"), text.alias("expansion"), F.lit("sequence_too_large_for_full_pair_discovery").alias("status"))
    return done.unionByName(left)


def folded_trees(df: DataFrame, key: str, order: Sequence[str], symbol: str, cap: int = 50_000) -> DataFrame:
    """By key, the rows of tree() of the folded sequence: key, node, parent, kind, symbol, repeats, first_pos, last_pos; in tasks as folded()."""
    import pandas as pd

    columns = ["node", "parent", "kind", "symbol", "repeats", "first_pos", "last_pos"]

    def build(pdf):
        pdf = pdf.sort_values("run")
        rows = tree(grammar_of_runs(zip(pdf["symbol"].tolist(), pdf["length"].tolist()), cap))
        return pd.DataFrame([(pdf[key].iloc[0], *r) for r in rows], columns=[key, *columns]).astype({"parent": "Int64"})

    short, long = _split(df, key, order, symbol, cap)
    done = short.groupBy(key).applyInPandas(build, f"`{key}` {df.schema[key].dataType.simpleString()}, node long, parent long, kind string, symbol string, repeats long, first_pos long, last_pos long")
    top = long.groupBy(key).agg(F.max("last_pos").alias("last_pos"))
    zero, one, none = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(None).cast("long")
    root = top.select(key, zero.alias("node"), none.alias("parent"), F.lit("root").alias("kind"), F.lit("").alias("symbol"), one.alias("repeats"), zero.alias("first_pos"), "last_pos")
    many = F.col("length") >= 2
    run = _running(long.withColumn("_cell", F.expr(f"run div {_CELL}")), [key], ["run"], many.cast("int"), "_repeats")
    run = run.withColumn("_at", F.col("first_pos") + F.col("_repeats") + 1)  # the node of the run, or of its one atom
    repeat = run.where(many).select(key, F.col("_at").alias("node"), zero.alias("parent"), F.lit("repeat").alias("kind"), "symbol", F.col("length").alias("repeats"), "first_pos", "last_pos")
    each = run.withColumn("_pos", F.explode(F.sequence("first_pos", "last_pos")))
    node = F.col("_at") + F.col("_pos") - F.col("first_pos") + many.cast("int")
    atom = each.select(key, node.alias("node"), F.when(many, F.col("_at")).otherwise(zero).alias("parent"), F.lit("atom").alias("kind"), "symbol", one.alias("repeats"), F.col("_pos").alias("first_pos"), F.col("_pos").alias("last_pos"))
    return done.unionByName(root).unionByName(repeat).unionByName(atom)
