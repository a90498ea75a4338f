from collections import defaultdict

import corpus_pipeline
from lodequarry.llm import queries

from .conftest import words


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    clean = [(k, words(k, 120 + k), "en", f"s{k % 3}", 0) for k in range(60)]
    copies = [(100 + k, clean[0][1], "en", "s1", 0) for k in range(5)]
    short = [(200 + k, "too short", "en", "s2", 0) for k in range(5)]
    docs = spark.createDataFrame(clean + copies + short + [(300, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        if name == "quality rules":
            assert {r["doc_id"] for r in docs.collect()} == {*range(60), *range(100, 105)}
        if name == "near duplicates":
            assert {r["doc_id"] for r in docs.collect()} == set(range(60))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    filled = defaultdict(int)
    for r in out:
        filled[r["sequence_id"]] += r["length"]
    assert out and max(filled.values()) <= 2048 and {r["doc_id"] for r in out} <= set(range(60))


def test_every_dealt_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_stages_keep_columns_whose_names_operators_use_and_empty_tables(spark, tmp_path):
    extra = "n_words int, kept string, size int, copies int, taken string, target int, copy int, base_failed string, source_size int, node string"
    own = (-5, "mine", -7, -1, "t", -2, -3, "b", -4, "n")
    rows = [(k, words(k, 120 + k), "en", f"s{k % 2}", *own) for k in range(6)] + [(9, None, None, None, *own)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() and all(tuple(r)[4:] == own for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from lodequarry.llm import shared

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared.scratch_root(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))
