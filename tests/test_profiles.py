import sqlite3

import pytest

from lodequarry.plans import recipes, sinks, timeline
from lodequarry.sources import profiles


def database(path, script, rows=()):
    with sqlite3.connect(path) as c:
        c.executescript(script)
        for sql, values in rows:
            c.executemany(sql, values)
    return str(path)


@pytest.fixture(scope="module")
def ascend(tmp_path_factory):
    names = ["", "KERNEL_AICORE", "MatMulV2", "MatMul", "EVENT_WAIT", "hcom_allReduce__1", "hcom", "aclnnMatmul", "aclrtSynchronizeStream"]
    task = [(k * 100, k * 100 + (60 if k % 4 else 20), 0, k, k, 9, 1 if k % 4 else 4, 0, k % 2, k, -1) for k in range(1, 21)]
    return database(
        tmp_path_factory.mktemp("p") / "msprof.db",
        """CREATE TABLE STRING_IDS(id INTEGER, value TEXT); CREATE TABLE TASK(startNs INTEGER, endNs INTEGER, deviceId INTEGER, connectionId INTEGER, globalTaskId INTEGER, globalPid INTEGER, taskType INTEGER, contextId INTEGER, streamId INTEGER, taskId INTEGER, modelId INTEGER);
        CREATE TABLE COMPUTE_TASK_INFO(globalTaskId INTEGER, name INTEGER, opType INTEGER, taskType INTEGER); CREATE TABLE COMMUNICATION_OP(opName INTEGER, opType INTEGER, startNs INTEGER, endNs INTEGER, connectionId INTEGER, groupName INTEGER, opId INTEGER, deviceId INTEGER);
        CREATE TABLE CANN_API(startNs INTEGER, endNs INTEGER, type INTEGER, globalTid INTEGER, connectionId INTEGER, name INTEGER);""",
        [
            ("INSERT INTO STRING_IDS VALUES (?, ?)", list(enumerate(names))),
            ("INSERT INTO TASK VALUES (?,?,?,?,?,?,?,?,?,?,?)", task),
            ("INSERT INTO COMPUTE_TASK_INFO VALUES (?,?,?,?)", [(k, 2, 3, 1) for k in range(1, 21) if k % 4]),
            ("INSERT INTO COMMUNICATION_OP VALUES (?,?,?,?,?,?,?,?)", [(5, 6, 1000, 1060, 10, 0, 1, 0)]),
            ("INSERT INTO CANN_API VALUES (?,?,?,?,?,?)", [(k * 100 - 90, k * 100 - 80, 0, (7 << 32) + 1, k, 7 if k % 5 else 8) for k in range(1, 21)]),
        ],
    )


def test_kinds_and_discovery(tmp_path, ascend):
    cuda = database(tmp_path / "a.sqlite", "CREATE TABLE StringIds(id INTEGER, value TEXT); CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL(start INTEGER, end INTEGER, deviceId INTEGER, streamId INTEGER, correlationId INTEGER, shortName INTEGER);")
    bad = database(tmp_path / "b.db", "CREATE TABLE TASK(startNs INTEGER); CREATE TABLE STRING_IDS(id INTEGER)")
    (tmp_path / "c.db").write_text("no database at all, but long enough to be read as one" * 20)
    assert profiles.discover(str(tmp_path)) == [(cuda, "cuda")] and profiles.kind_of(bad) is None
    assert profiles.format_label(ascend, profiles.kind_of(ascend)) == "ascend_monolithic_sqlite"
    assert profiles.evidence(str(tmp_path)) == ("absent", list(profiles.SPLIT_PARTS))


def test_table_scan_in_ranges(spark, ascend):
    df = profiles.read_table(spark, ascend, "TASK", 3)
    assert [r["row_id"] for r in df.orderBy("row_id").collect()] == list(range(1, 21)) and df.rdd.getNumPartitions() >= 1


def test_cuda_and_hip(spark, tmp_path):
    c = database(tmp_path / "c.db", """CREATE TABLE StringIds(id INTEGER, value TEXT); INSERT INTO StringIds VALUES (1, 'ncclKernel'), (2, 'gemm'), (3, 'cudaLaunchKernel'); CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL(start INTEGER, end INTEGER, deviceId INTEGER, streamId INTEGER, correlationId INTEGER, shortName INTEGER); INSERT INTO CUPTI_ACTIVITY_KIND_KERNEL VALUES (1, 5, 0, 7, 11, 1), (6, 9, 0, 7, 12, 2);
        CREATE TABLE CUPTI_ACTIVITY_KIND_MEMCPY(start INTEGER, end INTEGER, deviceId INTEGER, streamId INTEGER, correlationId INTEGER, bytes INTEGER); INSERT INTO CUPTI_ACTIVITY_KIND_MEMCPY VALUES (2, 3, 0, 8, 13, 100); CREATE TABLE CUPTI_ACTIVITY_KIND_RUNTIME(start INTEGER, end INTEGER, correlationId INTEGER, nameId INTEGER); INSERT INTO CUPTI_ACTIVITY_KIND_RUNTIME VALUES (0, 1, 11, 3);""")
    got = profiles.load(spark, c)
    assert {r["task_type"] for r in got["task"].collect()} == {"CUDA_KERNEL", "CUDA_COLLECTIVE_KERNEL", "CUDA_MEMCPY_AUX"} and got["communication"].count() == 1
    assert got["runtime_call"].first()["api_name"] == "cudaLaunchKernel"
    h = database(tmp_path / "h.db", "CREATE TABLE STR_TABLE(STR_ID INTEGER, STR_NAME TEXT); INSERT INTO STR_TABLE VALUES (1, 'k'); CREATE TABLE HIPOPS_1(BeginNs INTEGER, EndNs INTEGER, dev_id INTEGER, queue_id INTEGER, Name INTEGER, _Index INTEGER); INSERT INTO HIPOPS_1 VALUES (1, 4, 0, 0, 1, 1), (5, 5, 0, 0, 1, 2)")
    assert [r["op_name"] for r in profiles.load(spark, h)["task"].collect()] == ["k"]


def test_split_profile(spark, tmp_path):
    database(tmp_path / "ascend_task.db", "CREATE TABLE AscendTask(model_id INTEGER, index_id INTEGER, stream_id INTEGER, task_id INTEGER, context_id INTEGER, batch_id INTEGER, start_time NUMERIC, duration NUMERIC, host_task_type TEXT, device_task_type TEXT, connection_id INTEGER); INSERT INTO AscendTask VALUES (1, 1, 3, 4, 0, 0, 100, 25, 'KERNEL', 'AI_CORE', 9)")
    database(tmp_path / "ge_info.db", "CREATE TABLE TaskInfo(model_id INTEGER, op_name TEXT, stream_id INTEGER, task_id INTEGER, task_type TEXT, op_type TEXT); INSERT INTO TaskInfo VALUES (1, 'op', 3, 4, 'x', 'MatMul')")
    row = profiles.load(spark, str(tmp_path))["task"].first()
    assert (row["start_ns"], row["end_ns"], row["op_type"], row["task_type"]) == (100, 125, "MatMul", "KERNEL")
    assert profiles.evidence(str(tmp_path))[0] == "partial"


def test_analysis_end_to_end(spark, ascend, tmp_path):
    out = str(tmp_path / "out")
    t = timeline.analyze(spark, ascend, out)
    assert {"event", "anchor", "bubble", "tree", "runtime_relation", "host_activity"} <= set(t.relations)
    assert t.relations["event"].count() == 21
    roles = {r["role"]: r["n"] for r in t.sql("SELECT role, count(*) AS n FROM event GROUP BY role")}
    assert roles["auxiliary"] == 5 and roles["comm"] == 1 and roles["represented"] == 1 and roles["anchor"] == 14
    assert sum(x["union_ns"] for x in t.recipe("device_cost")) == 15 * 60 + 5 * 20
    for name in recipes.RECIPES:
        t.recipe(name)
    assert t.recipe("device_window_events", window_start_ns=100, window_end_ns=161)
    with pytest.raises(timeline.TooManyRows):
        t.sql("SELECT * FROM event", limit=5)
    with pytest.raises(ValueError):
        t.sql("DROP VIEW event")
    with pytest.raises(ValueError):
        sinks.publish(t.relations, out)
    t.export_perfetto(str(tmp_path / "trace"))
    import json

    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "trace")).collect())
    slices = json.loads("[" + ",".join(x.rstrip(",") for x in text.split("\n") if x.startswith("{")) + "]")
    assert len(slices) == 21 and {"name", "ph", "pid", "ts", "dur"} <= set(slices[0])


def test_catalog(spark):
    assert recipes.catalog(spark).count() == len(recipes.RECIPES)
    ready = {(r["recipe"], r["next"]) for r in recipes.continuations(spark).where("readiness = 'ready'").collect()}
    assert ("bubbles", "anchor_aux") in ready
