import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodequarry.llm import lm

from .conftest import rows, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW)), None]


def test_contexts_begin_anew_with_each_text():
    t, one, two = lm.with_ends(np.array([5, 6, 7]), np.array([2, 0, 1]))
    assert t.tolist() == [5, 6, 0, 0, 7, 0] and one.tolist() == [0, 5, 6, 0, 0, 7] and two.tolist() == [0, 0, 5, 0, 0, 0]


def test_classes_sum_to_one():
    shape = lm.Shape(words=20, width=4)
    words_ = lm.Words(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(lm.BUCKETS), 1, 1, 1, 21, np.full(shape.classes, 1 / shape.classes))
    m = lm.Model(shape, words_)
    one, two = m.hidden()
    p = np.exp((one[3] + two[7]) @ m.target.T + m.bias - m.normalisers()[3, 7])
    assert abs(p.sum() - 1) < 1e-4


def test_training_learns_what_follows_what():
    shape = lm.Shape(words=20, width=8, batch=512)
    rng = np.random.default_rng(0)
    seq = np.cumsum(rng.integers(1, 3, 40_000)) % 20 + 1
    uni = np.full(shape.classes, 1e-3)
    uni[1:21] = 1
    uni /= uni.sum()
    m = lm.Model(shape, lm.Words(*[np.empty(0, np.int64)] * 3, np.zeros(lm.BUCKETS), 1, 1, 1, 21, uni))

    def score():
        one, two = m.hidden()
        t, a, b = seq[2:], seq[1:-1], seq[:-2]
        return (np.einsum("ij,ij->i", one[a] + two[b], m.target[t]) + m.bias[t] - m.normalisers()[a, b]).mean()

    before = score()
    lm.train(m, uni, [(seq[k + 2 : k + 514], seq[k + 1 : k + 513], seq[k : k + 512]) for k in range(0, 39_000, 512)] * 4)
    assert score() > before + 1.0


def test_base_and_counts_over_odd_rows(spark, docs, nothing):
    held = (F.col("doc_id") % 3 == 0) & F.col("doc_id").isNotNull()
    got = lm.score(docs, held, lm.Shape(words=50, known=80, width=4)).collect()
    all_rows = [(r[0], tokens(r[1]), r[0] is not None and r[0] % 3 == 0) for r in rows()]
    c = Counter(t for _, ts, h in all_rows if not h for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), h, len(ts), sum(c[t] > 0 for t in ts), round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 5)) for i, ts, h in all_rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score(nothing, held).count() == 0
    none = lm.score(docs, F.lit(True), lm.Shape(words=50, known=80, width=4)).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def test_held_out_texts_score_above_the_base(spark):
    r = []
    for k in range(300):
        cycle = ["alpha", "beta", "gamma", "delta", "eps"] if k % 2 else ["uno", "dos", "tres", "quatro"]
        r.append((k, " ".join(cycle[j % len(cycle)] for j in range(k, k + 120))))
    got = lm.score(spark.createDataFrame(r, "doc_id long, text string"), F.col("doc_id") % 7 == 2, lm.Shape(words=20, width=8, batch=256)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_hashes_do_not_depend_on_place():
    a = lm.read(pa.array(["Ab cd", "cd  AB"]))
    assert a[0][0] == a[0][3] and a[0][1] == a[0][2] and a[2].tolist() == [2, 2]
    long = "x" * 200_000
    b = lm.read(pa.array([long + " q", "q " + long, words(3, 5)]))
    assert b[0][0] == b[0][3] and b[0][1] == b[0][2]
