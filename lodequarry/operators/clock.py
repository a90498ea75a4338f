"""Affine clock models between two clocks: slopes of all pairs, their median, and residuals on samples held out."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ClockModel:
    """target = round(intercept + slope * (source - reference)), round half to even; residuals in ns over the samples held out."""

    reference: int
    intercept: Fraction
    slope: Fraction
    p50: int
    p95: int
    worst: int
    samples: int

    def map(self, at_ns: int) -> int:
        return round(self.intercept + self.slope * (at_ns - self.reference))


def _middle(values: list[int]) -> Fraction:
    values = sorted(values)
    n = len(values)
    return Fraction(values[n // 2]) if n % 2 else Fraction(values[n // 2 - 1] + values[n // 2], 2)


def _ranks(values: list[int]) -> np.ndarray:
    """Equal values share a rank, counted from 0."""
    order = sorted(range(len(values)), key=values.__getitem__)
    out, at = np.zeros(len(values), np.int64), 0
    for a, b in zip(order, order[1:]):
        at += values[a] != values[b]
        out[b] = at
    return out


def _above(ranks: np.ndarray, equal: bool) -> np.ndarray:
    """For each place, how many places before it hold a greater rank (or an equal one); by the halves of ever larger blocks."""
    n = len(ranks)
    place, fewer, width = np.arange(n), np.zeros(n, np.int64), 1
    while width < n:
        block, right = place // (2 * width), place // width % 2 == 1
        keys = block * (n + 1) + ranks
        fewer[right] += np.searchsorted(np.sort(keys[~right]), keys[right], "left" if equal else "right") - block[right] * width
        width *= 2
    return place - fewer


def _middle_slope(xs: list[int], ys: list[int]) -> Fraction:
    """The median slope of all pairs with unlike xs, for samples in order of (x, y), without the pairs.

    A slope is at most s for the pairs that y - s * x puts in reverse, and those are counted in n log n. Slopes drawn from what is left on both sides of the wanted rank close in on it
    (Dillencourt, Mount and Netanyahu); memory grows with the samples, the time about with n log^3 n."""
    n, draw = len(xs), random.Random(7)
    first = np.zeros(n, np.int64)  # the first place of the same x
    for j in range(1, n):
        first[j] = first[j - 1] if xs[j] == xs[j - 1] else j

    def at(s: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = _ranks([s.denominator * y - s.numerator * x for x, y in zip(xs, ys)])
        return r, _above(r, False), _above(r, True)  # equal xs are in order of y, so they are never in reverse

    def find(k: int) -> tuple[Fraction, int]:
        """The slope of rank k from 0, and how many are smaller."""
        low = high = None  # ranks by the slopes that bound what is left, themselves not in it
        below, upto = np.zeros(n, np.int64), first
        while True:
            each = upto - below
            ends = np.cumsum(each)
            left, wanted = int(ends[-1]), k - int(below.sum())
            slopes = []
            for t in range(left) if left <= 64 else sorted(draw.randrange(left) for _ in range(64)):
                j = int(np.searchsorted(ends, t, "right"))
                inside = np.ones(first[j], bool)
                if high is not None:
                    inside &= high[: first[j]] > high[j]
                if low is not None:
                    inside &= low[: first[j]] < low[j]
                i = int(np.flatnonzero(inside)[t - int(ends[j] - each[j])])
                slopes.append(Fraction(ys[j] - ys[i], xs[j] - xs[i]))
            s = sorted(slopes)[wanted * len(slopes) // left]
            ranks, less, most = at(s)
            if k < less.sum():
                high, upto = ranks, less
            elif k >= most.sum():
                low, below = ranks, most
            else:
                return s, int(less.sum())

    pairs = int(first.sum())
    upper, smaller = find(pairs // 2)
    return upper if pairs % 2 or smaller < pairs // 2 else (find(pairs // 2 - 1)[0] + upper) / 2


def rank(values: Sequence[int], percent: int) -> int:
    """The value of nearest rank ceil(percent * n / 100)."""
    ordered = sorted(values)
    return ordered[max(1, -(-percent * len(ordered) // 100)) - 1]


def fit(pairs: Sequence[tuple[int, int]], every: int = 5) -> ClockModel:
    """Theil and Sen's line through (source, target) samples; each `every`-th sample, by source time, is held out and measured.

    Exact rational arithmetic relative to the first sample, as 64-bit floats do not hold nanoseconds since 1970. ValueError with fewer than three samples or one source time."""
    ordered = sorted(set(pairs))
    if len(ordered) < 3:
        raise ValueError("a clock model needs three samples")
    held = [p for k, p in enumerate(ordered) if k % every == every - 1] or ordered[-1:]
    used = [p for k, p in enumerate(ordered) if k % every != every - 1]
    x0 = ordered[0][0]
    xs, ys = [x - x0 for x, _ in used], [y for _, y in used]
    if xs[0] == xs[-1]:
        raise ValueError("all samples have one source time")
    slope = _middle_slope(xs, ys)
    intercept = _middle([slope.denominator * y - slope.numerator * x for x, y in zip(xs, ys)]) / slope.denominator
    model = ClockModel(x0, intercept, slope, 0, 0, 0, len(ordered))
    off = [abs(model.map(x) - y) for x, y in held]
    return ClockModel(x0, intercept, slope, rank(off, 50), rank(off, 95), max(off), len(ordered))


def fitted(samples: DataFrame, keys: Sequence[str], source: str, target: str) -> DataFrame:
    """A model per key: keys, slope_ppb (deviation from 1), intercept_ns, p50_ns, p95_ns, worst_ns, samples.

    One task fits one key, in memory that grows with its samples; see _middle_slope."""
    import pandas as pd

    schema = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf):
        m = fit(list(zip(pdf[source].astype(int).tolist(), pdf[target].astype(int).tolist())))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), round((m.slope - 1) * 10**9), round(m.intercept), m.p50, m.p95, m.worst, m.samples]], columns=[*keys, "slope_ppb", "intercept_ns", "p50_ns", "p95_ns", "worst_ns", "samples"])

    return samples.select(*keys, source, target).groupBy(*keys).applyInPandas(one, schema + ", slope_ppb long, intercept_ns long, p50_ns long, p95_ns long, worst_ns long, samples long")
