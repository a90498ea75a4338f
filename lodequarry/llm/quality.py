"""Quality rules whose cutoffs come with a guarantee: exact binomial bounds on labelled documents, corrected for all tests made."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodequarry.llm import shared

#: What each document is measured by; all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs")
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Cutoffs tried for each rule, as multiples of its unit: from the most lenient to the strictest.
GRID = 60


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)




def rules() -> dict[str, tuple[Column, float]]:
    """The rules as columns over the measures; made when first asked for, as columns need a session."""
    return {
        "symbols": (_ratio("n_symbols", "n_words"), 2.0 / GRID),
        "shouting": (_ratio("n_bangs", "n_words") + _ratio("n_capitals", "word_chars"), 2.0 / GRID),
        "lines": (_ratio("n_dup_lines", "n_lines"), 1.0 / GRID),
        "repeats": (_ratio("n_repeat_words", "n_words"), 1.0 / GRID),
    }


def _repeats(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """By document, the words that lie in a window of three words found twice or more in it."""
    out = np.zeros(docs, np.int64)
    if len(h) < 3:
        return out
    inside = doc[2:] == doc[:-2]
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    key = shared.mix(h[at] * np.uint64(3) + shared.mix(h[at + 1] * np.uint64(5) + shared.mix(h[at + 2] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(h), bool)
    for k in range(3):
        hit[at[twice] + k] = True
    return np.bincount(doc[hit], minlength=docs)


def measure(texts) -> dict[str, np.ndarray]:
    """The measures of an Arrow array of texts; a null text counts as empty."""
    buf, edge = shared.flat_texts(texts)
    docs = len(edge) - 1
    starts, ends = shared.word_spans(buf)
    doc = np.searchsorted(edge, starts, "right") - 1
    per = lambda where: np.diff(np.concatenate(([0], np.cumsum(where)))[edge])
    inside = shared._TABLE[buf]
    sym = np.zeros(256, bool)
    sym[list(SYMBOLS)] = True
    out = {
        "n_words": np.bincount(doc, minlength=docs),
        "word_chars": per(inside & ((buf & 0xC0) != 0x80)),
        "n_symbols": per(sym[buf]),
        "n_capitals": per((buf >= 65) & (buf <= 90)),
        "n_bangs": per(buf == 33),
        "n_repeat_words": _repeats(doc, shared.word_hashes(buf, starts, ends), docs),
    }
    stop = np.flatnonzero(buf == 10)
    begin = np.concatenate(([0], stop[:-1] + 1))
    words = np.searchsorted(starts, stop, "left") - np.searchsorted(starts, begin, "left")
    begin, stop = begin[words > 0], stop[words > 0]
    of = np.searchsorted(edge, begin, "right") - 1
    out["n_lines"] = np.bincount(of, minlength=docs)
    key = shared.mix(shared.word_hashes(buf, begin, stop) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    out["n_dup_lines"] = np.bincount(of[again], minlength=docs)
    return out


def _measuring(text_column: str):
    import pyarrow as pa

    def run(batches):
        shared.release(held=True)
        for whole in batches:
            for batch in shared.slices(whole, 2 << 20, text_column):
                got = measure(batch.column(batch.schema.get_field_index(text_column)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], [*batch.schema.names, *MEASURES])

    return run


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the measures of their whole texts as further columns; columns of these names are replaced."""
    docs = docs.drop(*MEASURES)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return docs.mapInArrow(_measuring(text_column), schema)


def base_failed() -> Column:
    """Too short, or more than half of it repeats: rejected whatever the labels say."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed in logarithms."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(good: list[int], risk: float, level: float) -> int:
    """How many cutoffs of a sequence, from the most lenient on, are certified: good[j] of sum(good) good documents have their value in the
    j-th cell from the top, so that cutoff j rejects good[0] + ... + good[j]. Each is tested against a true
    false-rejection rate of `risk` or more at `level`; the sequence ends with the first that isn't shown to be below, so no further correction is due within it."""
    n, k = sum(good), 0
    for j, g in enumerate(good):
        k += g
        if k > risk * n or tail(k, n, risk) > level:
            return j
    return len(good)


@dataclass(frozen=True)
class Cutoffs:
    """By stratum (null as None) and rule, the highest value that passes; and what the tests were about."""

    by_stratum: dict[str | None, dict[str, float]]
    risk: float
    confidence: float
    tests: int

    def failed(self, stratum: Column) -> Column:
        """Whether a measured document fails a rule of its stratum."""
        out = F.lit(False)
        for s, cuts in self.by_stratum.items():
            at = stratum.isNull() if s is None else stratum == F.lit(s)
            for rule, cut in cuts.items():
                value, unit = rules()[rule]
                out = out | (F.coalesce(at, F.lit(False)) & (F.floor(value / unit) > cut))
        return out


def calibrate(labelled: DataFrame, stratum: str = "lang", label: str = "quality", risk: float = 0.02, confidence: float = 0.95) -> Cutoffs:
    """Cutoffs from measured documents with a label (1: good, 0: bad, null: left aside).

    With the given confidence, in every stratum at once the share of good documents that the rules together reject beyond the base is below `risk`: each
    rule of each stratum gets risk / rules, and (1 - confidence) / (rules * strata) of the error (Bonferroni); its cutoffs are tested in
    a fixed sequence with exact binomial tails. Of the certified cutoffs the one with the most bad documents rejected, less the good ones, counts, the most lenient
    of equals, if it rejects more bad than good. A stratum with too few good labels certifies none and rejects by the base alone. The driver sees a row per stratum, rule and cell."""
    each = labelled.where(F.col(label).isin(0, 1) & ~base_failed())
    cell = lambda value, unit: F.least(F.floor(value / unit), F.lit(GRID)).cast("int")
    long = each.select(F.col(stratum).alias("stratum"), F.col(label).alias("label"), F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), cell(v, u).alias("cell")) for r, (v, u) in rules().items()))).alias("x"))
    rows = long.groupBy("stratum", "x.rule", "x.cell").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).collect()
    strata = {r["stratum"] for r in rows}
    tests = len(strata) * len(rules())
    counts = {(s, rule): (np.zeros(GRID + 1, np.int64), np.zeros(GRID + 1, np.int64)) for s in strata for rule in rules()}
    for r in rows:
        for k, v in enumerate((r["good"], r["bad"])):
            counts[r["stratum"], r["rule"]][k][r["cell"]] = v
    out: dict[str | None, dict[str, float]] = {s: {} for s in strata}
    for (s, rule), (good, bad) in counts.items():
        # cutoff j rejects the cells above GRID - 1 - j
        many = min(GRID, certified(good[::-1].tolist(), risk / len(rules()), (1 - confidence) / tests))
        gain = np.cumsum(bad[:0:-1] - good[:0:-1])[:many]
        if many and gain.max() > 0:
            out[s][rule] = float(GRID - 1 - int(np.argmax(gain)))
    return Cutoffs(out, risk, confidence, tests)


def judged(measured_docs: DataFrame, cutoffs: Cutoffs, stratum: str = "lang") -> DataFrame:
    """Measured documents with base_failed and kept."""
    return measured_docs.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~cutoffs.failed(F.col(stratum)))


def labels_of(measured_docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id") -> DataFrame:
    """Measured documents that have a label; an id labelled twice counts once, as bad if any row says so; null ids have none."""
    one = labels.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(label).alias("lq_label"))
    return measured_docs.drop(label).join(one.withColumnRenamed("lq_label", label), id_column)
