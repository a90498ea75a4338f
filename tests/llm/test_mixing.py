import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequarry.llm import mixing

from .conftest import rows


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.floats(0, 1))
def test_fit_takes_what_there_is_and_never_too_much(have, share):
    lengths, counts = np.array(sorted(have)), np.array([have[k] for k in sorted(have)])
    budget = int((lengths * counts).sum() * share)
    take = mixing.fit(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() <= budget
    left = budget - (lengths * take).sum()
    assert all(take[k] == counts[k] or lengths[k] > left for k in range(len(lengths)))


@settings(deadline=None, max_examples=300)
@given(st.dictionaries(st.sampled_from([0, 1, 2, 3, 4, 6, 10, 15, 100, 1000, 70_000, 70_001]), st.integers(1, 5), min_size=1, max_size=6), st.floats(0, 1))
def test_fit_is_the_best_subset_sum(have, share):
    lengths, counts = np.array(sorted(have)), np.array([have[k] for k in sorted(have)])
    budget = int((lengths * counts).sum() * share)
    take, sums = mixing.fit(lengths, counts, budget), {0}
    for n, c in have.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() == max(s for s in sums if s <= budget)


def test_fit_takes_long_documents_too():
    total = lambda n, c, budget: int((np.array(n) * mixing.fit(np.array(n), np.array(c), budget)).sum())
    assert total([3, 70_000], [5, 4], 70_000) == 70_000 and total([3, 70_000], [5, 4], 140_000) == 140_000 and total([70_000, 80_000], [1, 1], 75_000) == 70_000


def test_fit_meets_large_budgets():
    lengths = np.arange(1, 3000)
    counts = np.full(2999, 7)
    for share in (0.1, 0.5, 0.93):
        budget = int((lengths * counts).sum() * share)
        assert (lengths * mixing.fit(lengths, counts, budget)).sum() == budget


def test_targets_fill_up_to_the_cap():
    t = mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0)
    assert t[0] == 200 and abs(sum(t) - 450) < 1e-9 and abs(t[2] / t[1] - 2) < 1e-9
    assert mixing.targets([0, 10], [1, 1], 1.5, 2.0) == [0, 15]


def test_mix_over_odd_rows(docs, nothing):
    out = mixing.mix(docs)
    got = out.collect()
    assert len(got) == len(rows()) and out.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "node"]
    taken, total, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
        total[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["source_size"] is not None
    assert all(r["source_size"] == total[r["source"]] for r in got) and None in target
    assert all(taken[s] <= target[s] + 1 for s in target)
    again = {(r["doc_id"], r["text"], r["taken"]) for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {(r["doc_id"], r["text"], r["taken"]) for r in got}
    assert mixing.mix(nothing).count() == 0


def test_targets_are_met_where_lengths_allow(spark):
    df = spark.createDataFrame([(k, "w " * (k % 40 + 1), f"s{k % 3}") for k in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in got)


def test_fit_of_documents_longer_than_the_exact_part():
    assert mixing.fit(np.array([70_000, 80_000]), np.array([1, 1]), 75_000).tolist() == [1, 0]
    lengths, counts = np.array([90_000, 100_000, 110_003]), np.array([4, 4, 4])
    for budget in (250_000, 600_000, 990_007):
        left = budget - (lengths * (take := mixing.fit(lengths, counts, budget))).sum()
        assert 0 <= left < lengths[take < counts].min()


def test_fit_spreads_what_is_left_over_lengths():
    lengths = np.arange(1000, 4000)
    take = mixing.fit(lengths, np.ones(3000, int), int(lengths.sum() * 0.5))
    assert (lengths * take).sum() == int(lengths.sum() * 0.5) and 0.4 < take[:1500].mean() < 0.6
