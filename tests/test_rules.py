import pytest

from lodequarry.operators import rules
from lodequarry.sources import manifests

COLS = "task_type string, operator string, blob string, provider string"


def roles(spark, rows, **k):
    return [r["role"] for r in rules.classified(spark.createDataFrame(rows, COLS), rules.checked(rules.default_rules()), **k).collect()]


def test_roles_follow_precedence(spark):
    rows = [("EVENT_WAIT", "x", "x event_wait", "ascend"), ("KERNEL", "aiv_sync_matmul", "aiv_sync_matmul", "ascend"), ("KERNEL", "aiv_sync_matmul", "aiv_sync_matmul", "cuda"), ("event wait", "", "event wait", "ascend"), (None, None, None, None), ("T", "none", "none", "hygon")]
    assert roles(spark, rows) == ["auxiliary", "auxiliary", "anchor", "auxiliary", "unknown_anchor", "unknown_anchor"]


def test_numbered_detail_needs_its_task_type(spark):
    name = "MatmulAllReduceMc2AicpuKernel_12_3"
    rows = [("NOTIFY_WAIT_SQE", name, name.lower(), "ascend"), ("OTHER", name, name.lower(), "ascend"), ("NOTIFY_WAIT_SQE", name + "x", name.lower(), "ascend")]
    assert roles(spark, rows) == ["auxiliary", "anchor", "anchor"]


def test_rule_sets_that_contradict():
    r = rules.RoleRule(1, "any", "task", "blob", "contains", "x", "anchor", ("blob",))
    with pytest.raises(rules.RuleError):
        rules.checked([r, r])
    with pytest.raises(rules.RuleError):
        rules.checked([r, rules.RoleRule(1, "any", "task", "blob", "contains", "X", "auxiliary", ("blob",), rule_id="other")])


def test_symbols(spark):
    df = spark.createDataFrame([("hcom_allReduce_1", "ascend"), ("12_3", "ascend"), ("12_3", "cuda"), ("plain", "cuda"), (None, "cuda")], "n string, provider string")
    got = rules.normalised(df, rules.COLLECTIVE_SYMBOLS, "n", "provider").collect()
    assert [(r["structural_symbol"], r["outcome"]) for r in got] == [("AllReduce", "canonicalized"), ("AllReduce", "canonicalized"), ("12_3", "identity"), ("plain", "identity"), (None, "identity")]
    two = [rules.SymbolRule(5, "a", "contains", "al", "A"), rules.SymbolRule(5, "b", "contains", "all", "B")]
    assert [r["symbol_rule"] for r in rules.normalised(df.limit(1), two, "n").where("outcome = 'conflict'").collect()] == ["a|b"]


def test_kernel_base(spark):
    df = spark.createDataFrame([("MatMulV2_" + "a" * 32 + "_7",), ("MatMulV2_ND_x",), ("Add_high_precision_1",), ("Add_ND_x",), ("plain",)], "n string")
    assert [r[0] for r in df.select(rules.kernel_base(df["n"])).collect()] == ["MatMulV2", "MatMulV2", "Add", None, None]


def test_reconciliation(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "g", 0, 100), (1, "c", 0, 99), (2, "g", 0, 10), (2, "c", 5, 25), (3, "g", 0, 1), (3, "g", 0, 1), (3, "c", 0, 1), (4, "c", 0, 1)], "id long, kind string, start_ns long, end_ns long")
    got = rules.reconciled(df, ["id"], F.col("kind") == "g", F.col("kind") == "c").groupBy("id").agg(F.first("status")).collect()
    assert dict(map(tuple, got)) == {1: "reconciled", 2: "conflict", 3: "ambiguous", 4: "independent"}


def test_manifests():
    text = 'schema: x\nmetadata:\n  policy_id: "p"\nrules:\n  - rule_id: "r1"\n    priority: "5"\n    field: "blob"\n    match: "contains"\n    pattern: "zz"\n    role: "anchor"\n    required_fields: "blob"\n'
    m = manifests.parse(text, "yaml")
    assert m.metadata["policy_id"] == "p" and manifests.role_rules(m)[0].pattern == "zz"
    assert manifests.parse("# a: b\nrule_id\tx\nr\t1\n", "tsv").rows == [{"rule_id": "r", "x": "1"}]
    with pytest.raises(rules.RuleError):
        manifests.parse("rule_id\tx\nr\n", "tsv")
    base = [{"rule_id": "a", "v": "1"}, {"rule_id": "b", "v": "1"}]
    assert manifests.stacked(base, [{"rule_id": "b", "v": "2"}], "override")[1]["v"] == "2"
    with pytest.raises(rules.RuleError):
        manifests.stacked(base, [{"rule_id": "b"}], "extend")
