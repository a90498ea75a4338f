import random

import pytest

from lodequarry.operators import intervals as I

SCHEMA = "k long, id long, start_ns long, end_ns long, symbol string"


def rows(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(0, 400)
        out.append((r.randrange(3), i, a, a + r.choice([0, 1, 5, 30, 90]), r.choice("cxw")))
    return out


def union(spans):
    return len({t for a, b in spans for t in range(a, b)})


@pytest.fixture(scope="module", params=[1, 2])
def data(request, spark):
    r = rows(request.param)
    return r, spark.createDataFrame(r, SCHEMA)


def test_busy_is_the_union(data):
    r, df = data
    want = {k: union([(a, b) for q, _, a, b, _ in r if q == k]) for k in range(3)}
    assert {x["k"]: x["union_ns"] for x in I.busy(df, ["k"]).collect()} == want
    assert {x["k"]: x["union_ns"] for x in I.busy_binned(df, ["k"], 50).collect()} == want


def test_overlaps_match_all_pairs(data):
    r, df = data
    for closed in (False, True):
        hit = (lambda a, b, c, d: a <= d and c <= b) if closed else (lambda a, b, c, d: a < d and c < b)
        want = sorted((x[1], y[1]) for x in r for y in r if x[0] == y[0] and hit(x[2], x[3], y[2], y[3]))
        got = I.overlap_join(df, df, ["k"], 40, closed)
        assert sorted((x["id"], x["r_id"]) for x in got.collect()) == want


def test_containment(data):
    r, df = data
    want = sorted((x[1], y[1]) for x in r for y in r if x[0] == y[0] and x[2] <= y[2] and y[3] <= x[3])
    assert sorted((x["id"], x["r_id"]) for x in I.containment_join(df, df, ["k"], 40).collect()) == want


def test_following_anchor(data):
    r, df = data
    anchors = [x for x in r if x[4] == "c"]
    got = I.following(df.where("symbol = 'x'"), df.where("symbol = 'c'"), ["k"], "end_ns", "start_ns", "id").collect()
    for x in got:
        later = [(a[2], a[1]) for a in anchors if a[0] == x["k"] and a[2] >= x["end_ns"]]
        assert x["following"] == (min(later)[1] if later else None)


def test_ownership_conserves_the_union(data):
    from pyspark.sql import functions as F

    r, df = data
    owned = {(x["k"], x["id"]): x["owned_ns"] for x in I.ownership(df, ["k"], "id", F.when(F.col("symbol") == "c", 1).otherwise(0), 64).collect()}
    want = {}
    for k in range(3):
        for t in range(600):
            on = [(x[4] != "c", x[1]) for x in r if x[0] == k and x[2] <= t < x[3]]
            if on:
                want[k, min(on)[1]] = want.get((k, min(on)[1]), 0) + 1
    assert owned == want


def test_gaps_split_into_communication_work_and_silence(data):
    from pyspark.sql import functions as F

    r, df = data
    gap = I.gaps(df.where("symbol = 'c'"), ["k"], "id")
    got = I.gap_costs(gap, df.where("symbol <> 'c'"), ["k"], "id", F.col("symbol") == "x", F.col("symbol") == "w", 40).collect()
    spans = {x["id"]: (x["k"], x["gap_start"], x["gap_end"]) for x in gap.collect()}
    assert len(got) == len(spans)
    for x in got:
        k, a, b = spans[x["id"]]
        clip = lambda s: [(max(a, y[2]), min(b, y[3])) for y in r if y[0] == k and y[4] == s and y[2] < b and a < y[3]]
        comm, both = union(clip("x")), union(clip("x") + clip("w"))
        assert (x["comm_ns"], x["exec_ns"], x["idle_ns"]) == (comm, both - comm, b - a - both)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert I.busy(df, ["k"]).count() == I.overlap_join(df, df, ["k"]).count() == I.islands(df, ["k"]).count() == 0


def test_nearest_like_all_pairs(spark):
    r = random.Random(8)
    left = [(r.choice([0, 1, 2, None]), k, r.choice([None, *range(12)])) for k in range(60)]
    right = [(r.choice([0, 1, None]), k, r.choice([None, *range(12)])) for k in range(25)]
    want = {}
    for k, i, t in left:
        near = [(abs(u - t), u, j) for q, j, u in right if q == k and k is not None and t is not None and u is not None]
        if near:
            want[i] = (min(near)[2], min(near)[0])
    got = I.nearest(spark.createDataFrame(left, "k int, a int, t long"), spark.createDataFrame(right, "k int, b int, u long"), ["k"], "a", "t", "b", "u").collect()
    assert {x["a"]: (x["nearest"], x["delta_ns"]) for x in got} == want and len(got) == len(want)


def test_ownership_of_many_at_once_makes_no_pairs(spark):
    from pyspark.sql import functions as F

    n = 3_000
    df = spark.range(n).select(F.lit(0).alias("k"), "id", F.col("id").alias("start_ns"), (F.lit(2 * n) - F.col("id")).alias("end_ns"), F.lit("x").alias("symbol"))
    owned = I.ownership(df, ["k"], "id", F.col("id"), 10**6)
    assert {(x["id"], x["owned_ns"]) for x in owned.collect()} == {(k, 2 if k < n - 1 else n - k + 1) for k in range(n)}
    assert not [x for x in ("Join", "CartesianProduct") if x in owned._jdf.queryExecution().executedPlan().toString()]


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(1_001)
    assert (I.tasks(df), I.tasks(df, df, rows=100), I.tasks(df.limit(0))) == (4, 21, 4)
    plan = I.nearest(df.selectExpr("id AS k", "id AS a", "id AS t"), df.selectExpr("id AS k", "id AS b", "id AS u"), ["k"], "a", "t", "b", "u")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_overlaps_are_ranked_where_they_are_met(spark):
    r = random.Random(9)
    some = lambda n, ids: [(r.randrange(2), r.choice(ids) if r.random() < 0.2 else 100 + k, a, a + r.choice([0, 3, 40])) for k in range(n) for a in [r.randrange(120)]]
    left, right = some(40, [1, 2]), some(50, [7])
    want = {}
    for k, i, a, b in left:
        want.setdefault(i, []).extend((c, d, j) for q, j, c, d in right if q == k and a < d and c < b)
    schema = "k long, id long, start_ns long, end_ns long"
    got = I.ordered_overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "id", 8)
    assert sorted((x["id"], x["observed_order"], x["r_start_ns"], x["r_end_ns"], x["r_id"]) for x in got.collect()) == sorted((i, n, *x) for i, v in want.items() for n, x in enumerate(sorted(v)))
