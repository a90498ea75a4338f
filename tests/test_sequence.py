import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequarry.operators import sequence as Q

from . import slow_grammar

SYMBOLS = st.lists(st.sampled_from("abc"), max_size=60)


@settings(deadline=None, max_examples=150)
@given(SYMBOLS)
def test_grammar_keeps_the_sequence(s):
    g = Q.grammar(s)
    assert [x for n, _, _ in g.nodes for x in Q.expand(g, n)] == s
    assert [(a, b) for _, a, b in g.nodes] == sorted((a, b) for _, a, b in g.nodes)
    pairs = {}
    for x, y in zip(g.nodes, g.nodes[1:]):
        if x[0] != y[0]:
            pairs[x[0], y[0]] = pairs.get((x[0], y[0]), 0) + 1
    assert all(n < 2 for n in pairs.values())


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from("abc"), max_size=90), st.booleans())
def test_grammar_equals_the_slow_one(s, guarded):
    ok = (lambda a, b: not (a < 20 <= b)) if guarded else (lambda a, b: True)
    got, want = Q.grammar(s, allowed=ok), slow_grammar.grammar(s, allowed=ok)
    assert (got.nodes, got.steps, got.macros, got.status) == (want.nodes, want.steps, want.macros, want.status)


@settings(deadline=None, max_examples=100)
@given(SYMBOLS)
def test_tree_has_every_position_once(s):
    rows = Q.tree(Q.grammar(s))
    assert [r[3] for r in sorted((r for r in rows if r[2] == "atom"), key=lambda r: r[5])] == s
    by = {r[0]: r for r in rows}
    for r in rows[1:]:
        assert by[r[1]][5] <= r[5] and r[6] <= by[r[1]][6]


def test_runs_fold_before_pairs():
    g = Q.grammar(list("aabaab"))
    assert g.steps[0] == ("run_fold", "M1", 2) and g.macros["M1"].parts == ("a",)
    assert len(g.nodes) == 2 or len(g.nodes) == 1


def test_cap_and_protection():
    assert Q.grammar(list("abcabc"), cap=3).status == "sequence_too_large_for_full_pair_discovery"
    g = Q.grammar(list("abab"), allowed=lambda a, b: False)
    assert [n[0] for n in g.nodes] == list("abab")


@pytest.mark.parametrize("seed", range(30))
def test_periodic_suffix_against_search(seed):
    r = random.Random(seed)
    ids = [r.randrange(2) for _ in range(r.randrange(0, 14))]
    best = None
    for start in range(len(ids)):
        for p in range(1, len(ids)):
            tail = ids[start:]
            if len(tail) // p >= 2 and all(tail[k] == tail[k - p] for k in range(p, len(tail))):
                key = (len(tail), len(tail) // p, -p)
                best = max(best or key, key)
    got = Q.periodic_suffix(ids)
    assert (got and (len(ids) - got[0], got[2], -got[1])) == best


def test_periodic_suffix_of_a_long_sequence_is_linear():
    assert Q.periodic_suffix(list("x" * 3 + "ab" * 100_000)) == (3, 2, 100_000, 0)
    assert Q.periodic_suffix([0] * 199_999 + [1]) is None


def test_motif():
    assert Q.primitive(list("abab")) == ["a", "b"] and Q.primitive(list("aba")) == list("aba") and Q.primitive([]) == []


def test_runs_and_grams(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabbba")] + [(2, 0, "a")], "k long, t long, s string")
    assert [tuple(r) for r in Q.runs(df, ["k"], ["t"], "s").orderBy("k", "run").select("k", "symbol", "first_pos", "length").collect()] == [(1, "a", 0, 2), (1, "b", 2, 3), (1, "a", 5, 1), (2, "a", 0, 1)]
    grams = Q.ngrams(df, ["k"], ["t"], "s", 2, 3)
    assert grams.where("length = 3").count() == 4 and grams.where("gram = 'b>b'").count() == 2
    guard = spark.createDataFrame([(1, 7, 1, 3, "no_cross"), (2, 8, 0, 0, "block_any_overlap")], "k long, interval_id long, first_token long, last_token long, policy string")
    bad = {(r["first_pos"], r["length"]) for r in Q.violations(grams, guard, ["k"]).where("violates = 7").collect()}
    assert bad == {(0, 2), (0, 3), (2, 3), (3, 2), (3, 3)}


def test_violations_hold_over_stretches_of_any_width(spark):
    r = random.Random(4)
    grams = [(r.randrange(2), a, a + r.randrange(1, 6), f"g{k}") for k in range(60) for a in [r.randrange(40)]]
    guard = [(r.randrange(2), k, a, a + r.randrange(0, 12), r.choice(["no_cross", "allow_enclosing", "block_any_overlap"])) for k in range(8) for a in [r.randrange(40)]]
    def bad(a, b, s, e, policy):
        inside, around = a >= s and b <= e, a <= s and b >= e
        return a <= e and b >= s and {"no_cross": not inside, "allow_enclosing": not inside and not around, "block_any_overlap": True}[policy]
    want = {g[3]: min(((s, i) for k, i, s, e, p in guard if k == g[0] and bad(g[1], g[2], s, e, p)), default=(0, None))[1] for g in grams}
    g = spark.createDataFrame(grams, "k long, first_pos long, last_pos long, gram string")
    i = spark.createDataFrame(guard, "k long, interval_id long, first_token long, last_token long, policy string")
    for width in (1, 7, 256):
        assert {x["gram"]: x["violates"] for x in Q.violations(g, i, ["k"], width).collect()} == want


def test_long_runs_and_grams_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(Q, "_CELL", 7)
    r = random.Random(5)
    rows = [(r.choice([0, 1, None]), r.choice([None, *range(40)]), k, r.choice("aab")) for k in range(150)]
    df = spark.createDataFrame(rows, "k long, t long, i long, s string")
    kept = lambda x: sorted(map(tuple, x.collect()), key=repr)
    assert kept(Q.long_runs(df, ["k"], ["t", "i"], "s")) == kept(Q.runs(df, ["k"], ["t", "i"], "s"))
    want = []
    for key in (0, 1, None):
        line = [x[3] for x in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))]
        want += [(key, p, p + n - 1, n, ">".join(line[p : p + n])) for n in (2, 3) for p in range(len(line) - n + 1)]
    grams = Q.ngrams(df, ["k"], ["t", "i"], "s", 2, 3)
    assert kept(grams) == sorted(want, key=repr)
    assert all("_cell" in x or "_block" in x for x in grams._jdf.queryExecution().executedPlan().toString().splitlines() if "+- Window [" in x and "_before" not in x)


def test_sequences_over_the_cap_are_folded_without_python(spark):
    r = random.Random(6)
    lines = {1: r.choices("aab", k=200), 2: list("abcabcab"), 3: r.choices("ab", k=90)}
    df = spark.createDataFrame([(k, i, s) for k, x in lines.items() for i, s in enumerate(x)], "k long, t long, s string")
    want = [(k, n, s, a, b, ">".join(Q.expand(g, s)), g.status) for k, x in lines.items() for g in [Q.grammar(x, 30)] for n, (s, a, b) in enumerate(g.nodes)]
    assert {x[0] for x in want if x[6] != "done"} == {1, 3}
    assert sorted(map(tuple, Q.folded(df, "k", ["t"], "s", 30).collect())) == sorted(want)
    trees = {(k, *x) for k, line in lines.items() for x in Q.tree(Q.grammar(line, 30))}
    assert {tuple(x) for x in Q.folded_trees(df, "k", ["t"], "s", 30).collect()} == trees
    short, long = Q._split(df, "k", ["t"], "s", 30)
    assert {x["k"] for x in short.collect()} == {2} and {x["k"] for x in long.collect()} == {1, 3}
