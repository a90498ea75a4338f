"""Best-fit packing of documents into sequences: bin completion by branch and bound over the counts of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequarry.llm import shared, tokens

#: (times, lengths from the largest): so many sequences are filled alike.
Pattern = tuple[int, tuple[int, ...]]
#: Rows of the table of first ranks (partitions x lengths) up to which it is broadcast; a larger one is joined by an exchange.
SMALL = 1 << 15
#: Bytes of pieces that an encoder remembers here.
MEMORY = 80 << 20


def best_fit(counts: np.ndarray, room: int) -> list[Pattern]:
    """Best-fit decreasing on counts by length; groups of equal bins are kept as one."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        while left:
            gap = min((g for g in groups if g >= size), default=None)
            if gap is None:
                per = room // size
                whole, rest = divmod(left, per)
                for fill, times in (((size,) * per, whole), ((size,) * rest, 1)):
                    if fill and times:
                        at = groups.setdefault(room - size * len(fill), {})
                        at[fill] = at.get(fill, 0) + times
                break
            fill, times = groups[gap].popitem()
            fits = min(gap // size, left)
            many = min(times, left // fits)
            if times > many:
                groups[gap][fill] = times - many
            if not groups[gap]:
                del groups[gap]
            at = groups.setdefault(gap - size * fits, {})
            new = (*fill, *(size,) * fits)
            at[new] = at.get(new, 0) + many
            left -= many * fits
    return [(n, fill) for at in groups.values() for fill, n in at.items()]


def _l2(counts: np.ndarray, room: int) -> int:
    """No packing has fewer sequences: the sum of lengths, or what cannot share a sequence (Martello and Toth's L2), for all thresholds at once."""
    size = np.arange(len(counts))
    n, volume = np.append(np.cumsum(counts[::-1])[::-1], 0), np.append(np.cumsum((counts * size)[::-1])[::-1], 0)
    half = min(room // 2 + 1, len(counts))
    k = np.arange(half)  # lengths of at least k; over room-k: alone; over half the room: one each
    top = np.minimum(np.maximum(room - k + 1, half), len(counts))
    free = (n[half] - n[top]) * room - (volume[half] - volume[top])
    extra = np.maximum(0, -((free - (volume[k] - volume[half])) // room))
    return max(-(-int(volume[0]) // room), int((n[half] + extra).max(initial=0)))


def lower_bound(counts: np.ndarray, room: int) -> int:
    """No packing has fewer sequences: L2 of what is left after forced choices (Martello and Toth's L3).

    The largest piece goes with the piece that fills its sequence, or alone where nothing fits, or with the largest that fits where no two do: no choice is better. Where no
    such choice is left, the smallest length is given up, which cannot raise the number, and the rest is looked at again."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    sizes = np.flatnonzero(left).tolist()
    done, best = 0, 0
    while sizes:
        moved, at = False, len(sizes) - 1
        while at >= 0:
            top = sizes[at]
            if not left[top]:
                sizes.pop(at)
                at = min(at, len(sizes)) - 1
                continue
            gap = room - top
            fits = bisect_right(sizes, gap) - 1
            while fits >= 0 and not left[sizes[fits]] - (sizes[fits] == top):
                fits -= 1
            if fits < 0:  # alone
                done, left[top], moved = done + int(left[top]), 0, True
                continue
            mate = sizes[fits]
            small = next(s for s in sizes if left[s] - (s == top))
            if mate == gap or 2 * small > gap:
                n = int(left[top]) // 2 if mate == top else min(int(left[top]), int(left[mate]))
                if n:
                    left[top] -= n
                    left[mate] -= n
                    done, moved = done + n, True
                    continue
            at -= 1
        best = max(best, done + _l2(left, room))
        if not moved or not sizes:
            if not sizes:
                break
            left[sizes.pop(0)] = 0
    return best


def fillings(counts: np.ndarray, gap: int, waste: Callable[[], int], budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill a gap from what is left, lazily: all of them, as long as the budget of steps lasts.

    A piece as long as what is still open dominates every other way to go on. A filling is dominated if a piece not in it would fit
    too, or could stand for one or two of its pieces without leaving more open. Fillings that leave more open than waste() are no use; so are prefixes
    that even all smaller pieces cannot bring so far. Pieces are tried from the longest on, the most of a length first, so the first are the fullest or nearly so."""
    sizes = np.flatnonzero(counts[: gap + 1]).tolist()
    sizes = sizes[1:] if sizes and sizes[0] == 0 else sizes
    have = {s: int(counts[s]) for s in sizes}
    volume = [0]
    for s in sizes:
        volume.append(volume[-1] + s * have[s])

    def spare(fill: tuple[int, ...], low: int, high: int) -> bool:
        """Whether a piece of low to high is not in the filling."""
        return any(have[s] > fill.count(s) for s in sizes[bisect_left(sizes, low) : bisect_right(sizes, high)])

    def dominated(fill: tuple[int, ...], open_: int) -> bool:
        each = sorted(set(fill))
        for i, a in enumerate(each):
            if spare(fill, a + 1, a + open_):
                return True
            for b in each[i:]:
                if (b > a or fill.count(a) > 1) and spare(fill, a + b, a + b + open_):
                    return True
        return False

    def go(open_: int, upper: int, fill: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        budget[0] -= 1
        if budget[0] < 0:
            return
        if not open_ or (open_ <= upper and open_ in have):
            fill = (*fill, open_) if open_ else fill
            if not dominated(fill, 0):
                yield fill
            return
        for k in range(bisect_right(sizes, min(open_, upper)) - 1, -1, -1):
            if open_ - volume[k + 1] > waste():
                return
            a = sizes[k]
            for n in range(min(have[a], open_ // a), 0, -1):
                yield from go(open_ - n * a, a - 1, (*fill, *(a,) * n))
        if open_ <= waste() and not spare(fill, 1, open_) and not dominated(fill, open_):
            yield fill

    return go(gap, gap, ())


@dataclass(frozen=True)
class Packing:
    """Patterns that use every piece once, how many sequences no packing can go below, and whether the search came to its end."""

    patterns: list[Pattern]
    least: int
    ended: bool

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.patterns)

    @property
    def gap(self) -> int:
        """Sequences above the lower bound; none if the search ended, as the packing is then shown to be the best."""
        return 0 if self.ended else self.sequences - self.least


def complete(counts: np.ndarray, room: int, steps: int = 200_000) -> Packing:
    """Bin completion: best fit is the first incumbent; a depth-first search over all undominated fillings around the largest piece left prunes
    where the room wasted so far already costs as many sequences as the incumbent, and ends when the lower bound is met, when nothing is left to try, or after
    `steps` pieces tried (the gap then tells what is open). A filling is used as often as the counts allow first, then once, which with what follows covers every number of uses."""
    counts = counts.astype(np.int64)
    best = best_fit(counts, room)
    most, least = sum(n for n, _ in best), lower_bound(counts, room)
    volume, budget = int((counts * np.arange(len(counts))).sum()), [steps]

    def children(left: np.ndarray, waste: int):
        top = int(np.flatnonzero(left)[-1])
        less = left.copy()
        less[top] -= 1
        for once in (False, True):
            for fill in fillings(less, room - top, lambda: (most - 1) * room - volume - waste, budget):
                sizes, need = np.unique((top, *fill), return_counts=True)
                times = int((left[sizes] // need).min())
                if once and times == 1:
                    continue
                times = 1 if once else times
                rest = left.copy()
                rest[sizes] -= times * need
                yield rest, times, (top, *fill)

    stack = [(children(counts, 0), None, 0, 0)] if counts[1:].any() else []
    while stack and most > least and budget[0] > 0:
        nodes, path, used, waste = stack[-1]
        step = next(nodes, None)
        if step is None:
            stack.pop()
            continue
        left, times, fill = step
        used, waste, path = used + times, waste + times * (room - sum(fill)), (path, (times, fill))
        if used >= most or -(-(volume + waste) // room) >= most:
            continue
        if left.any():
            stack.append((children(left, waste), path, used, waste))
            continue
        most, best = used, []
        while path:
            path, step = path
            best.append(step)
    return Packing(best, least, most <= least or budget[0] > 0)


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, offset): the pieces of that length from a rank on go into one
    sequence each from there on, at the offset. Bounded by the patterns, thus by the lengths, not by the pieces."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, fill in patterns:
        offset = 0
        for size in fill:
            out.setdefault(size, []).append((rank.get(size, 0), sequence, offset))
            rank[size] = rank.get(size, 0) + times
            offset += size
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def cut(length: int, room: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else the rest first and full pieces after it."""
    if length <= room:
        return [length]
    first = length % room
    return [first] * (first > 0) + [room] * (length // room)


def _pieces(room: int, vocabulary: str, end: int, id_column: str, with_ids: bool):
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for whole in batches:
            for batch in shared.slices(whole, 2 << 20):
                ids, count = tokens.encoder(vocabulary, MEMORY).encode(batch.column(batch.schema.get_field_index("text")), end)
                ids = ids.astype("<u4", copy=False)
                rows: list[list] = [[], [], [], [], []]
                token_lists = []
                doc = batch.column(batch.schema.get_field_index(id_column)).to_pylist()
                at = 0
                for d, n in zip(doc, count.tolist()):
                    begin = 0
                    for k, size in enumerate(cut(n, room)):
                        lo = at + begin
                        for c, v in zip(rows, (d, k, begin, size, zlib.crc32(ids[lo : lo + size]))):
                            c.append(v)
                        if with_ids:
                            token_lists.append(ids[lo : lo + size].astype(np.int64))
                        begin += size
                    at += n
                size = np.array(rows[3], np.int64)
                order = np.argsort(size, kind="stable")
                run_of = np.concatenate(([0], np.flatnonzero(np.diff(size[order])) + 1)) if len(size) else np.empty(0, np.int64)
                local = np.empty(len(size), np.int64)
                local[order] = np.arange(len(size)) - np.repeat(run_of, np.diff(np.append(run_of, len(size)))) + seen[size[order]]
                seen += np.bincount(size, minlength=room + 1)
                cols = [pa.array(rows[0], batch.schema.field(id_column).type), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:]), pa.array(local), pa.array(np.full(len(size), part, np.int32))]
                names = [id_column, "piece", "start", "length", "ids_crc32", "local", "part"]
                if with_ids:
                    cols, names = [*cols, pa.array(token_lists, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _place(slots: dict[int, np.ndarray], names: list[str]):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            size, rank = get("length"), get("local") + get("base")
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                which, table = np.flatnonzero(size == s), slots[s]
                k = np.searchsorted(table[:, 0], rank[which], "right") - 1
                sequence[which] = table[k, 1] + rank[which] - table[k, 0]
                offset[which] = table[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, room: int = 2048, vocabulary: str | None = None, end: int = 0, id_column: str = "doc_id", with_ids: bool = False, steps: int = 200_000, report: dict | None = None) -> DataFrame:
    """Pack documents (a text column) into sequences of at most `room` token ids.

    A row per piece: id column, piece, start, length, ids_crc32, sequence_id, offset and, with with_ids, the ids. Only
    documents longer than the room are cut. A null or empty text is the end id alone. Rows with the same or a null id are packed each on
    its own; other columns are left aside. An empty table gives no rows. The driver sees only how many pieces each length has
    (at most `room` rows); pieces find their place by their rank among those of their length, without one task holding a length. `steps` bounds the search (see complete);
    report, if given, gets sequences, least (what no packing goes below) and gap (how many sequences might be saved; 0: none).
    """
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, local long, part int" + ", ids array<long>" * with_ids
    cutter = _pieces(room, vocabulary or tokens.default_vocabulary(), end, id_column, with_ids)
    made = shared.staged(docs.select(id_column, "text").mapInArrow(cutter, schema), "pieces")
    counts = shared.staged(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    by_length = np.zeros(room + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        by_length[r["length"]] = r["n"]
    full, by_length[room] = int(by_length[room]), 0
    found = complete(by_length, room, steps)
    if report is not None:
        report.update(sequences=found.sequences + full, least=found.least + full, gap=found.gap)
    slots = places([*found.patterns, *[(full, (room,))] * (full > 0)])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.select(*names).schema) + ", sequence_id long, offset long"
    base = F.broadcast(base) if counts.count() <= SMALL else base.hint("merge")
    return made.join(base, ["part", "length"]).mapInArrow(_place(slots, names), out)
