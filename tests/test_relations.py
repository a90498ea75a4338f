import random

from pyspark.sql import functions as F

from lodequarry.functions import scalars as S
from lodequarry.operators import intervals as I
from lodequarry.operators import relations as R
from lodequarry.operators import structure as T


def test_every_call_and_unit_has_a_state(spark):
    calls = spark.createDataFrame([(1, 10), (2, 11), (3, 11), (4, 12), (5, None)], "call_id long, correlation_id long")
    work = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 13), (5, None)], "work_id long, correlation_id long")
    got = {(r["call_id"], r["work_id"], r["support_state"]) for r in R.correlated(calls, work).collect()}
    assert got == {(1, 1, "supported_deterministic"), (1, 2, "supported_deterministic"), (2, None, "rejected_reused_correlation_id"), (3, None, "rejected_reused_correlation_id"), (None, 3, "rejected_reused_correlation_id"), (4, None, "unmatched_call"), (5, None, "missing_runtime_identifier"), (None, 4, "unmatched_work"), (None, 5, "missing_device_identifier")}


def test_activities_close_at_synchronisation(spark):
    df = spark.createDataFrame([(1, k, k, s) for k, s in enumerate("LLSSLSL")], "t long, id long, start_ns long, kind string")
    got = R.activities(df, ["t"], ["id"], F.col("kind") == "L", F.col("kind") == "S").orderBy("activity").collect()
    assert [(r["launches"], r["closed_by_sync"]) for r in got] == [(2, True), (1, True), (1, False)]


def test_greedy_pairs(spark):
    df = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 1), (1, 2, 2, 2), (1, 2, 1, 9)], "g long, a long, b long, d long")
    assert {(r["a"], r["b"]) for r in R.greedy_pairs(df, ["g"], "a", "b", "d").collect()} == {(1, 2), (2, 1)}


def test_walk_and_rollup(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "parent string, child string")
    tree = T.walk(edges)
    assert {(r["node"], r["depth"], r["path"]) for r in tree.collect()} == {("a", 0, "a"), ("b", 1, "a/b"), ("c", 1, "a/c"), ("d", 2, "a/c/d")}
    leaves = spark.createDataFrame([("d", 2), ("b", 3), ("d", 4)], "node string, v long")
    assert {r["node"]: r["v"] for r in T.rolled_up(tree, leaves, {"v": F.sum("v")}).collect()} == {"a": 9, "b": 3, "c": 6, "d": 6}


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 2), (None, 2)], "a long, b long")
    assert [tuple(r) for r in df.select(S.null_least("a", "b"), S.null_greatest("a", "b"), S.ppm(F.col("a"), F.lit(3).cast("long"))).collect()] == [(1, 2, 333333), (None, None, None)]


def test_public_text(spark):
    rows = [("fine text", True), ("my api key is", False), ("see https://x", False), ("a < b", False), ("tokens count", True), ("token", False), ("eyJabc.def", False), ("bell \x07", False)]
    df = spark.createDataFrame(rows, "t string, ok boolean")
    assert df.where(S.public_text(F.col("t")) != F.col("ok")).count() == 0


def test_claimed_takes_the_greedy_pairs_of_overlaps_without_them(spark):
    r = random.Random(2)
    for width, ids in ((40, 30), (400, 30), (40, 8)):
        side = lambda name: spark.createDataFrame([(k % 2, r.randrange(ids) if ids < 30 else k, a, a + r.choice([0, 1, 9, 30])) for k in range(30) for a in [r.randrange(width)]], f"g long, {name} long, start_ns long, end_ns long").localCheckpoint()
        a, b = side("a"), side("b")
        met = I.overlap_join(a, b, ["g"], 50).withColumn("delta", F.abs(F.col("r_start_ns") - F.col("start_ns")))
        assert sorted(map(tuple, R.claimed(a, b, ["g"], "a", "b").collect())) == sorted(map(tuple, R.greedy_pairs(met, ["g"], "a", "b", "delta").collect()))


def test_claims_of_many_that_all_overlap():
    n = 20_000  # 10^8 pairs
    got = R.nearest_first(list(range(2 * n)), [4 * n] * 2 * n, [k // 2 for k in range(2 * n)], [k % 2 == 0 for k in range(2 * n)])
    assert got == [(2 * k, 2 * k + 1) for k in range(n)]
