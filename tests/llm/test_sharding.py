from collections import Counter

from lodequarry.llm import sharding

from .conftest import rows


def test_shards_are_even_whole_and_gapless(docs):
    out = sharding.shard(docs, shards=5)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "size", "shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in rows())
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_even_sizes_copies_and_ties(spark):
    r = [(k, f"text number {k} " * (k % 5 + 1)) for k in range(600)] + [(k, "the same text") for k in range(1000, 1400)]
    got = sharding.shard(spark.createDataFrame(r, "doc_id long, text string"), shards=8, tolerance=0.01).collect()
    total = Counter()
    for x in got:
        total[x["shard"]] += x["size"]
    mean = sum(total.values()) / 8
    assert len(total) == 8 and max(abs(v - mean) for v in total.values()) < 0.03 * mean
    assert len({x["shard"] for x in got if x["text"] == "the same text"}) <= 4
    again = sharding.shard(spark.createDataFrame(r[::-1], "doc_id long, text string").repartition(5), shards=8, tolerance=0.01).collect()
    assert {(x["doc_id"], x["shard"], x["slot"]) for x in got} == {(x["doc_id"], x["shard"], x["slot"]) for x in again}


def test_no_rows_and_wide_ids(spark, nothing):
    assert sharding.shard(nothing).count() == 0
    df = spark.createDataFrame([(-(1 << 63), "a"), ((1 << 63) - 1, "a"), (0, "a"), (None, "a")], "doc_id long, text string")
    assert sorted(r["slot"] for r in sharding.shard(df, shards=1).collect()) == [0, 1, 2, 3]
