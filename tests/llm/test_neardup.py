import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lodequarry.llm import neardup
from lodequarry.llm.components import components

from .conftest import rows, words


def multiset(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(docs):
    sets = [multiset(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and similarity(sets[a], sets[b]) >= 0.8:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return sets, [root(k) for k in range(len(docs))]


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(1)
    base = [words(k, 3) for k in range(60)]
    a = " ".join(r.choice(base) for _ in range(400))
    b = " ".join(a.split(" ")[:700]) + " " + words(5, 300)
    doc, key, count, n = neardup.shingles(pa.array([a, b, a, "", "one two"]))
    s = neardup.signatures(doc, key, count, n, 600)
    assert (s[0] == s[2]).all() and np.isinf(s[3]).all() and np.isfinite(s[4]).all()
    true = similarity(multiset(a), multiset(b))
    assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 600)


def test_counts_weigh(spark):
    a, b = "a b c d e " * 30, "a b c d e " * 10
    got = neardup.similar(pa.array([a, a]), pa.array([b, a]), 5, 0.8)
    assert got.tolist() == [similarity(multiset(a), multiset(b)) >= 0.8, True]


def test_rarest_tokens_are_shared_by_similar_texts(spark):
    r = random.Random(4)
    texts = []
    for k in range(12):
        w = words(k, 120).split(" ")
        texts += [" ".join(w), " ".join([*w[: 100 - k], "new", *w[100 - k :]])]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {}
    for row in neardup.prefixes(df, 5, 0.8).collect():
        got.setdefault(row["node"], set()).add(row["token"])
    for a in range(len(texts)):
        for b in range(a):
            if similarity(multiset(texts[a]), multiset(texts[b])) >= 0.8:
                assert got[a] & got[b]
    assert r is not None


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 260)] + [(None, 3), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {k: root(k) for k in up} and len(got) == len(up)


def test_classes_over_odd_rows_and_shared_passages(spark, docs, nothing):
    passage = words(50, 90)
    more = [(200 + k, passage + " " + words(300 + k, 5 + 9 * k), "en", "s1", 0, "x", "x") for k in range(12)]
    everything = rows() + more
    df = docs.union(spark.createDataFrame(more, docs.schema))
    plain = [(r[0], r[1]) for r in everything]
    sets, root = brute(plain)
    got = neardup.classes(df).collect()
    assert len(got) == len(plain)
    by = {}
    for r in got:
        if r["has_words"]:
            by.setdefault(r["class_id"], set()).add(r["doc_id"])
    want = {}
    for k, (i, _) in enumerate(plain):
        if sets[k]:
            want.setdefault(root[k], set()).add(i)
    assert sorted(map(str, by.values())) == sorted(map(str, want.values()))
    assert sum(r["kept"] for r in got if not r["has_words"]) == sum(not s for s in sets)
    left = neardup.deduplicated(df)
    assert left.columns == df.columns and left.count() == len(want) + sum(not s for s in sets)
    assert neardup.classes(nothing).count() == 0 and neardup.deduplicated(nothing).count() == 0


def near_group(members, outliers):
    """Texts of one passage with two words changed, or three to four, which are similar to few others."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    out = []
    for k in range(members + outliers):
        w = list(base)
        for at in r.sample(range(4, 146), 2 if k < members else 3 + k % 2):
            w[at] = f"x{k}x{at}"
        out.append(" ".join(w))
    return out


def test_differences_decide_similarity(spark):
    texts = near_group(20, 12) + [" ".join(near_group(1, 0)[0].split(" ")[: 150 - 5 * k]) for k in range(6)]
    df = spark.createDataFrame([(k, t, 5, texts[5]) for k, t in enumerate(texts)], "node long, text string, hub long, hub_text string")
    got = {r["node"]: (set(r["unlike"]), r["over"]) for r in neardup.differences(df, 5, 0.8).collect()}
    sets = [multiset(t) for t in texts]
    lowest = min(got, key=lambda k: got[k][1])
    assert len(got) == len(texts)
    for a in range(len(texts)):
        for b in range(a):
            need = got[a][1] + got[b][1]
            assert (len(got[a][0] & got[b][0]) >= need - 1e-6) == (similarity(sets[a], sets[b]) >= 0.8 - 1e-9)
            if need <= 0:
                assert similarity(sets[a], sets[lowest]) >= 0.8 - 1e-9 and similarity(sets[b], sets[lowest]) >= 0.8 - 1e-9


def test_a_large_group_and_its_outliers_are_not_compared_pair_by_pair(spark, monkeypatch):
    texts = near_group(160, 60)
    made, staged = [], neardup.shared.staged

    def counted(df, name):
        out = staged(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup.shared, "staged", counted)
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    _, root = brute(list(enumerate(texts)))
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(root)) and len(got) == len(texts)
    assert len(made) == 2 and made[1] < 5 * len(texts)


def test_a_task_sends_only_the_counters_that_it_moved():
    import pandas as pd

    parts = [pa.RecordBatch.from_pydict({"text": [words(k, 200), words(1, 60)]}) for k in range(3)]
    sent = [b for x in parts for b in neardup._tallier(5)([x])]
    assert sum(b.nbytes for b in sent) < 100_000
    got = np.zeros(neardup.SLOTS, np.int64)
    for chunk, rows_ in pd.concat([b.to_pandas() for b in sent]).groupby("chunk"):
        got[chunk * neardup._CHUNK : (chunk + 1) * neardup._CHUNK] = np.frombuffer(neardup._summed(rows_)["tally"].iloc[0], np.int64)
    want = np.zeros(neardup.SLOTS, np.int64)
    for x in parts:
        want += np.bincount((neardup.tokens_of(x.column(0), 5)[1] & np.uint64(neardup.SLOTS - 1)).astype(np.int64), minlength=neardup.SLOTS)
    assert (got == want).all()
