"""Queries over sources and sinks: small profiles, logs and manifests are written from the nations (25 rows at every scale), read back by the readers, and must give what SQL says of the nations."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sqlite3
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequarry.operators import rules, sequence
from lodequarry.plans import sinks
from lodequarry.plans.registry import query
from lodequarry.plans.timeline import Timeline, analyze, bundled_rules
from lodequarry.sources import inference_log, manifests, profiles
from lodequarry.sources.tables import table
from lodequarry.streaming import imports


def _folder(spark: SparkSession) -> str:
    """A new folder that tasks can see: below spark.checkpoint.dir where it is a path of files, else a temporary one (a local session)."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if root.startswith("/"):
        os.makedirs(root, exist_ok=True)
        return tempfile.mkdtemp(prefix="lodequarry-sources-", dir=root)
    return tempfile.mkdtemp(prefix="lodequarry-sources-")


def _nations(spark: SparkSession, sf: str) -> list[tuple[int, str, int]]:
    return sorted((r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in table(spark, sf, "nation").collect())


def _database(path: str, script: str, rows: dict[str, list[tuple]]) -> str:
    with sqlite3.connect(path) as c:
        c.executescript(script)
        for name, values in rows.items():
            if values:
                c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
    return path


def _ascend(spark: SparkSession, sf: str, folder: str) -> str:
    """Device d of region d: a task a nation, with a kind by region; even ones are compute, and every nation makes a host call."""
    n = _nations(spark, sf)
    return _database(
        f"{folder}/msprof.db",
        """CREATE TABLE STRING_IDS(id INTEGER, value TEXT);
        CREATE TABLE TASK(startNs INTEGER, endNs INTEGER, deviceId INTEGER, connectionId INTEGER, globalTaskId INTEGER, globalPid INTEGER, taskType INTEGER, contextId INTEGER, streamId INTEGER, taskId INTEGER, modelId INTEGER);
        CREATE TABLE COMPUTE_TASK_INFO(globalTaskId INTEGER, name INTEGER, opType INTEGER, taskType INTEGER);
        CREATE TABLE CANN_API(startNs INTEGER, endNs INTEGER, type INTEGER, globalTid INTEGER, connectionId INTEGER, name INTEGER);""",
        {
            "STRING_IDS": [(k, name) for k, name, _ in n] + [(100 + r, f"type{r}") for r in range(5)],
            "TASK": [(k * 100, k * 100 + 60, r, k if k % 4 else -1, k, 9, 100 + r, -1, k % 3, k, -1) for k, _, r in n],
            "COMPUTE_TASK_INFO": [(k, k, 100 + r, 100 + r) for k, _, r in n if k % 2 == 0],
            "CANN_API": [(k * 100 + 10, k * 100 + 20, 0, k % 7, k, k) for k, _, _ in n],
        },
    )


def _cuda(spark: SparkSession, sf: str, folder: str) -> str:
    """A kernel a nation, a collective where the key ends with 0 or 5; a copy and a graph trace for some, a host call for all."""
    n = _nations(spark, sf)
    return _database(
        f"{folder}/nsys.sqlite",
        """CREATE TABLE StringIds(id INTEGER, value TEXT);
        CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL(start INTEGER, end INTEGER, deviceId INTEGER, streamId INTEGER, correlationId INTEGER, shortName INTEGER);
        CREATE TABLE CUPTI_ACTIVITY_KIND_MEMCPY(start INTEGER, end INTEGER, deviceId INTEGER, streamId INTEGER, correlationId INTEGER, bytes INTEGER);
        CREATE TABLE CUPTI_ACTIVITY_KIND_RUNTIME(start INTEGER, end INTEGER, globalTid INTEGER, correlationId INTEGER, nameId INTEGER);
        CREATE TABLE CUPTI_ACTIVITY_KIND_GRAPH_TRACE(start INTEGER, end INTEGER, deviceId INTEGER, streamId INTEGER, correlationId INTEGER, graphId INTEGER);""",
        {
            "StringIds": [(k, f"ncclDevKernel_{name}" if k % 5 == 0 else name) for k, name, _ in n],
            "CUPTI_ACTIVITY_KIND_KERNEL": [(k * 10, k * 10 + 4, r, k % 3, k, k) for k, _, r in n],
            "CUPTI_ACTIVITY_KIND_MEMCPY": [(k * 10 + 5, k * 10 + 6, r, 9, 100 + k, k) for k, _, r in n if k % 2],
            "CUPTI_ACTIVITY_KIND_RUNTIME": [(k * 10 - 3, k * 10 - 1, 7, k, k) for k, _, _ in n],
            "CUPTI_ACTIVITY_KIND_GRAPH_TRACE": [(k * 10, k * 10 + 9, r, 1, k, k) for k, _, r in n if k % 3 == 0],
        },
    )


def _hip(spark: SparkSession, sf: str, folder: str) -> str:
    """An operation a nation; those of keys 7, 14 and 21 end as they begin."""
    n = _nations(spark, sf)
    return _database(
        f"{folder}/hip.db",
        """CREATE TABLE STR_TABLE(STR_ID INTEGER, STR_NAME TEXT);
        CREATE TABLE HIPOPS_1(BeginNs INTEGER, EndNs INTEGER, dev_id INTEGER, queue_id INTEGER, Name INTEGER, _Index INTEGER);""",
        {"STR_TABLE": [(k, name) for k, name, _ in n], "HIPOPS_1": [(k * 5, k * 5 + (0 if k and k % 7 == 0 else 3), r, k % 2, k, k) for k, _, r in n]},
    )


@query("SRC-01", "SELECT * FROM (VALUES ('a/msprof.db', 'ascend'), ('b/nsys.sqlite', 'cuda'), ('c/d/hip.db', 'hygon')) t(path, kind)")
def discovery(spark, sf):
    root = _folder(spark)
    for name in ("a", "b", "c/d", "timeline"):
        os.makedirs(f"{root}/{name}")
    _ascend(spark, sf, f"{root}/a")
    _cuda(spark, sf, f"{root}/b")
    _hip(spark, sf, f"{root}/c/d")
    _hip(spark, sf, f"{root}/timeline")  # our own output is not searched
    with open(f"{root}/c/x.db", "w") as f:
        f.write("no database " * 200)
    return spark.createDataFrame([(os.path.relpath(p, root), k) for p, k in profiles.discover(root)], "path string, kind string")


@query("SRC-03", """SELECT n_nationkey + 1 AS event_id, n_regionkey AS device_id, n_nationkey % 3 AS stream_id, n_nationkey * 100 AS start_ns, n_nationkey * 100 + 60 AS end_ns,
 CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END AS connection_id, 'type' || n_regionkey AS task_type, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS op_name FROM nation""")
def ascend_tasks(spark, sf):
    task = profiles.load(spark, _ascend(spark, sf, _folder(spark)))["task"]
    return task.select("event_id", "device_id", "stream_id", "start_ns", "end_ns", "connection_id", "task_type", "op_name")


@query("SRC-04", "SELECT n_nationkey + 1 AS row_id, n_nationkey AS task_id FROM nation")
def rowid_ranges(spark, sf):
    return profiles.read_table(spark, _ascend(spark, sf, _folder(spark)), "TASK", 4).select("row_id", F.col("taskId").alias("task_id"))


@query("SRC-07", "SELECT n_nationkey + 1 AS call_id, n_nationkey * 100 + 10 AS start_ns, n_nationkey * 100 + 20 AS end_ns, n_nationkey AS connection_id, n_name AS api_name FROM nation")
def host_calls(spark, sf):
    return profiles.load(spark, _ascend(spark, sf, _folder(spark)))["runtime_call"].select("call_id", "start_ns", "end_ns", "connection_id", "api_name")


@query("SRC-08", "SELECT n_regionkey AS device_id, n_nationkey AS task_id, n_nationkey * 10 AS start_ns, n_nationkey * 10 + 5 AS end_ns, n_name AS op_name FROM nation")
def split_profile(spark, sf):
    folder, n = _folder(spark), _nations(spark, sf)
    for r in range(5):  # a database of tasks a device, one of names for all
        os.makedirs(f"{folder}/device_{r}")
        _database(
            f"{folder}/device_{r}/ascend_task.db",
            "CREATE TABLE AscendTask(model_id INTEGER, index_id INTEGER, stream_id INTEGER, task_id INTEGER, context_id INTEGER, batch_id INTEGER, start_time NUMERIC, duration NUMERIC, host_task_type TEXT, device_task_type TEXT, connection_id INTEGER, device_id INTEGER)",
            {"AscendTask": [(1, 1, 2, k, 0, 0, k * 10, 5, "KERNEL", "AI_CORE", k, r) for k, _, d in n if d == r]},
        )
    _database(f"{folder}/ge_info.db", "CREATE TABLE TaskInfo(model_id INTEGER, op_name TEXT, stream_id INTEGER, task_id INTEGER, task_type TEXT, op_type TEXT)", {"TaskInfo": [(1, name, 2, k, "x", "t") for k, name, _ in n]})
    return profiles.load(spark, folder)["task"].select("device_id", "task_id", "start_ns", "end_ns", "op_name")


@query("SRC-09", "SELECT 'ascend_task.db' AS part, 'AscendTask' AS name, count(*) AS n FROM nation UNION ALL SELECT 'ge_info.db', 'TaskInfo', count(DISTINCT n_regionkey) FROM nation")
def split_inventory(spark, sf):
    folder, n = _folder(spark), _nations(spark, sf)
    _database(f"{folder}/ascend_task.db", "CREATE TABLE AscendTask(task_id INTEGER)", {"AscendTask": [(k,) for k, _, _ in n]})
    _database(f"{folder}/ge_info.db", "CREATE TABLE TaskInfo(op_name TEXT)", {"TaskInfo": [(x,) for x in sorted({str(r) for _, _, r in n})]})
    return profiles.inventory(spark, folder).select("part", F.col("table").alias("name"), "n")


@query("SRC-10", "SELECT n_nationkey + 1 AS event_id, n_regionkey AS device_id, n_nationkey * 10 AS start_ns, CASE WHEN n_nationkey % 5 = 0 THEN 'ncclDevKernel_' ELSE '' END || n_name AS op_name, CASE WHEN n_nationkey % 5 = 0 THEN 'CUDA_COLLECTIVE_KERNEL' ELSE 'CUDA_KERNEL' END AS task_type FROM nation")
def cuda_kernels(spark, sf):
    return profiles.load(spark, _cuda(spark, sf, _folder(spark)))["task"].where("task_type like '%KERNEL'").select("event_id", "device_id", "start_ns", "op_name", "task_type")


@query("SRC-11", "SELECT n_regionkey AS device_id, n_nationkey * 10 + 5 AS start_ns, n_nationkey + 100 AS connection_id, 'CUDA_MEMCPY_AUX' AS task_type FROM nation WHERE n_nationkey % 2 = 1")
def cuda_copies(spark, sf):
    return profiles.load(spark, _cuda(spark, sf, _folder(spark)))["task"].where("task_type = 'CUDA_MEMCPY_AUX'").select("device_id", "start_ns", "connection_id", "task_type")


@query("SRC-12", "SELECT n_regionkey AS device_id, n_nationkey * 10 AS start_ns, n_nationkey * 10 + 9 AS end_ns FROM nation WHERE n_nationkey % 3 = 0")
def cuda_graphs(spark, sf):
    return profiles.load(spark, _cuda(spark, sf, _folder(spark)))["graph_trace"].select("device_id", "start_ns", "end_ns")


@query("SRC-13", "SELECT * FROM (VALUES ('cuda', 'cuda_nsys_sqlite'), ('ascend', 'ascend_monolithic_sqlite'), ('hygon', 'hygon_hip_sqlite')) t(kind, label)")
def detection(spark, sf):
    folder = _folder(spark)
    found = [(p, profiles.kind_of(p)) for p in (_cuda(spark, sf, folder), _ascend(spark, sf, folder), _hip(spark, sf, folder))]
    return spark.createDataFrame([(k, profiles.format_label(p, k)) for p, k in found], "kind string, label string")


@query("SRC-14", "SELECT n_regionkey AS device_id, n_nationkey % 2 AS stream_id, n_nationkey * 5 AS start_ns, n_nationkey * 5 + 3 AS end_ns, n_name AS op_name FROM nation WHERE n_nationkey = 0 OR n_nationkey % 7 <> 0")
def hip_operations(spark, sf):
    return profiles.load(spark, _hip(spark, sf, _folder(spark)))["task"].select("device_id", "stream_id", "start_ns", "end_ns", "op_name")


@query("SRC-18", "SELECT CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END AS sequence, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 7 END AS at_ns, n_nationkey % 5 = 0 AS refused FROM nation")
def inference_lines(spark, sf):
    bad = ('{"a":1,"a":2}', "no json", "[]")
    lines = [bad[k % 3] if k % 5 == 0 else _line(k, name) for k, name, _ in _nations(spark, sf)]
    return inference_log.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).select("sequence", "at_ns", F.col("error").isNotNull().alias("refused"))


def _line(key: int, name: str) -> str:
    return json.dumps({"schema_version": 1, "event_id": f"e{key}", "trace_id": f"{key + 1:032x}", "span_id": f"{key + 1:016x}", "producer_id": "p", "clock_id": "c", "sequence": key, "event_type": "span_start", "wall_time_ns": key, "monotonic_ns": key * 7, "name": name})


def _imported(spark: SparkSession, sf: str) -> tuple[str, list[dict[str, int]]]:
    """A store after three imports: ten lines and one of them again, all lines, all once more."""
    store, lines = f"{_folder(spark)}/store", [_line(k, name) for k, name, _ in _nations(spark, sf)]
    said = [inference_log.import_batch(store, spark.createDataFrame([(x,) for x in part], "value string")) for part in (lines[:10] + lines[:1], lines, lines)]
    return store, said


@query("SRC-19", "SELECT n_nationkey AS sequence, 'e' || n_nationkey AS event_id FROM nation")
def idempotent_import(spark, sf):
    return spark.read.parquet(_imported(spark, sf)[0]).select("sequence", "event_id")


@query("STR-01", "SELECT * FROM (VALUES (0, 11, 10, 0, 1), (1, 25, 15, 10, 0), (2, 25, 0, 25, 0)) t(batch, lines, added, known, repeated)")
def receipts(spark, sf):
    return spark.createDataFrame([(k, *(r[c] for c in ("lines", "new", "known", "repeated"))) for k, r in enumerate(_imported(spark, sf)[1])], "batch int, lines int, added int, known int, repeated int")


@query("SRC-20", "SELECT n_name AS rule_id, CASE WHEN n_nationkey % 6 = 0 THEN 'overlay' ELSE 'r' || n_regionkey END AS role FROM nation")
def rule_manifests(spark, sf):
    n = _nations(spark, sf)
    base = manifests.parse("# version: 1\nrule_id\trole\n" + "".join(f"{name}\tr{r}\n" for _, name, r in n), "tsv")
    over = manifests.parse("version: 2\nrules:\n" + "".join(f"  - rule_id: {name}\n    role: overlay\n" for k, name, _ in n if k % 6 == 0), "yaml")
    return spark.createDataFrame([(r["rule_id"], r["role"]) for r in manifests.stacked(base.rows, over.rows, "override")], "rule_id string, role string")


@query("SRC-21", "SELECT n_nationkey + 1 AS row_id, n_nationkey AS k, n_regionkey / 2.0 AS x, n_name AS name FROM nation")
def typed_rows(spark, sf):
    path = _database(f"{_folder(spark)}/typed.db", "CREATE TABLE t(k INTEGER, x REAL, name TEXT)", {"t": [(k, r / 2, name) for k, name, r in _nations(spark, sf)]})
    return profiles.read_table(spark, path, "t", 3)


@query("SRC-22", "SELECT 'partial' AS state, 'runtime.db,api_event.db,hccl_single_device.db' AS lacking")
def evidence(spark, sf):
    folder = _folder(spark)
    for part in profiles.SPLIT_PARTS[:2]:
        _database(f"{folder}/{part}", "CREATE TABLE t(k INTEGER)", {})
    state, lacking = profiles.evidence(folder)
    return spark.createDataFrame([(state, ",".join(lacking))], "state string, lacking string")


@query("SNK-01", "SELECT n_nationkey, n_name FROM nation")
def published(spark, sf):
    out = f"{_folder(spark)}/published"
    sinks.publish({"lq_nation": table(spark, sf, "nation").select("n_nationkey", "n_name")}, out)
    return sinks.opened(spark, out)["lq_nation"]


@query("SNK-07", """SELECT 'raw:TASK' AS lane, n_regionkey AS pid, n_nationkey % 3 AS tid, n_nationkey * 100 AS start_ns FROM nation
 UNION ALL SELECT 'raw:CANN_API', 0, n_nationkey % 7, n_nationkey * 100 + 10 FROM nation""")
def raw_lanes(spark, sf):
    db = _ascend(spark, sf, _folder(spark))
    read = lambda name: profiles.read_table(spark, db, name)
    return sinks.raw_lanes({"TASK": (read("TASK"), "deviceId", "streamId"), "CANN_API": (read("CANN_API"), None, "globalTid")}).select("lane", "pid", "tid", "start_ns")


@query("SNK-10", "SELECT n_regionkey AS rank, count(*) * 10 AS slope_ppb, min(n_nationkey) * 1000 AS intercept_ns, 0 AS reference_ns FROM nation GROUP BY 1")
def clock_models(spark, sf):
    path = f"{_folder(spark)}/clocks.jsonl"
    by: dict[int, list[int]] = {}
    for k, _, r in _nations(spark, sf):
        by.setdefault(r, []).append(k)
    with open(path, "w") as f:
        f.writelines(json.dumps({"rank": r, "slope_ppb": len(k) * 10, "intercept_ns": min(k) * 1000, "reference_ns": 0}) + "\n" for r, k in by.items())
    return sinks.clock_models(spark, f"file://{path}")


@query("SNK-12", "SELECT string_agg(line, chr(10) ORDER BY path) || chr(10) AS text FROM (SELECT '- world' AS line, '' AS path UNION ALL SELECT '  - ' || r_name, r_name FROM region)")
def loop_tree(spark, sf):
    r = table(spark, sf, "region")
    tree = spark.createDataFrame([("world", None, 0, "")], "node string, parent string, depth int, path string").union(r.select("r_name", F.lit("world"), F.lit(1), "r_name"))
    return spark.createDataFrame([(sinks.tree_markdown(tree, expanded=True),)], "text string")


@query("API-02", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey >= 5 GROUP BY 1")
def facade_sql(spark, sf):
    got = Timeline(spark, {"lq_nations": table(spark, sf, "nation")}).sql("SELECT n_regionkey, count(*) AS n FROM lq_nations WHERE n_nationkey >= :least GROUP BY 1", {"least": 5})
    return spark.createDataFrame([(r["n_regionkey"], r["n"]) for r in got], "n_regionkey long, n long")


@query("API-03", "SELECT n_name AS name, n_regionkey AS pid, n_nationkey % 3 AS tid FROM nation")
def facade_perfetto(spark, sf):
    out = f"{_folder(spark)}/trace"
    nation, key = table(spark, sf, "nation"), F.col("n_nationkey").cast("long")
    events = nation.select(F.col("n_name").alias("symbol"), F.col("n_regionkey").alias("device_id"), (key % 3).alias("stream_id"), (key * 100).alias("start_ns"), (key * 100 + 60).alias("end_ns"))
    Timeline(spark, {"event": events}).export_perfetto(f"file://{out}")
    slices = spark.read.text(f"file://{out}").where("value like '{%'")
    j = lambda k: F.get_json_object("value", f"$.{k}")
    return slices.select(j("name").alias("name"), j("pid").cast("long").alias("pid"), j("tid").cast("long").alias("tid"))


def written_back(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df after a trip through a published folder, for queries about sinks."""
    out = f"{_folder(spark)}/{name}"
    sinks.publish({name: df}, out)
    return sinks.opened(spark, out, "lq_")[name]


@query("SNK-03", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def derived_table(spark, sf):
    return written_back(spark, table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations")), "by_region")


@query("RUL-06", "SELECT n_name AS rule_id, CASE WHEN n_nationkey % 6 = 0 THEN 'overlay' ELSE 'r' || n_regionkey END AS role, TRUE AS order_is_nothing, TRUE AS a_role_is_something FROM nation")
def overlaid_rules(spark, sf):
    n = _nations(spark, sf)
    base, over = {name: {"role": f"r{r}"} for _, name, r in n}, {name: {"role": "overlay"} for k, name, _ in n if k % 6 == 0}
    got, digest = rules.overlaid(base, over)
    same = rules.overlaid(dict(reversed(base.items())), over)[1] == digest
    other = rules.overlaid(base, {**over, n[0][1]: {"role": "another"}})[1] != digest
    return spark.createDataFrame([(k, v["role"], same, other) for k, v in got.items()], "rule_id string, role string, order_is_nothing boolean, a_role_is_something boolean")


def _followed(spark: SparkSession, sf: str, published=None) -> str:
    """A store after a folder of three segments was followed, a segment at a time: starts, ends of nations whose key is no multiple of 3, and the starts again.

    Nations whose key is a multiple of 8 have no start."""
    folder, n = _folder(spark), _nations(spark, sf)
    starts = [_line(k, name) for k, name, _ in n if k % 8]
    ends = [json.dumps(json.loads(_line(100 + k, name)) | {"trace_id": f"{k + 1:032x}", "span_id": f"{k + 1:016x}", "event_type": "span_end", "status": "ok"}) for k, name, _ in n if k % 3]
    os.makedirs(f"{folder}/segments")
    for at, lines in enumerate((starts, ends, starts)):
        with open(f"{folder}/segments/{at}.jsonl", "w") as f:
            f.writelines(x + "\n" for x in lines)
        os.utime(f"{folder}/segments/{at}.jsonl", (1_700_000_000 + at, 1_700_000_000 + at))  # read in this order
    imports.follow(spark, f"file://{folder}/segments", f"file://{folder}/store", f"file://{folder}/checkpoint", published, files=1).awaitTermination()
    return f"file://{folder}/store"


@query("STR-02", "SELECT n_nationkey AS sequence, 'span_start' AS event_type FROM nation WHERE n_nationkey % 8 <> 0 UNION ALL SELECT 100 + n_nationkey, 'span_end' FROM nation WHERE n_nationkey % 3 <> 0")
def followed_folder(spark, sf):
    return spark.read.parquet(_followed(spark, sf)).select("sequence", "event_type")


@query("STR-03", """SELECT CASE WHEN n_nationkey % 8 = 0 THEN 'unobserved' ELSE n_name END AS name, CASE WHEN n_nationkey % 8 = 0 THEN 'missing_start' WHEN n_nationkey % 3 = 0 THEN 'open' ELSE 'ok' END AS status,
 CASE WHEN n_nationkey % 8 <> 0 AND n_nationkey % 3 <> 0 THEN 700 END AS duration_ns FROM nation WHERE n_nationkey % 8 <> 0 OR n_nationkey % 3 <> 0""")
def assembled_spans(spark, sf):
    return imports.spans(spark, _followed(spark, sf)).select("name", "status", "duration_ns")


@query("STR-07", "SELECT 0 AS batch, count(*) AS spans, CAST(0 AS BIGINT) AS finished FROM nation WHERE n_nationkey % 8 <> 0 UNION ALL SELECT 1, count(*), count(*) FILTER (n_nationkey % 8 <> 0 AND n_nationkey % 3 <> 0) FROM nation WHERE n_nationkey % 8 <> 0 OR n_nationkey % 3 <> 0")
def snapshots(spark, sf):
    out: list[tuple] = []
    _followed(spark, sf, lambda df, number: out.append((number, df.count(), df.where("status = 'ok'").count())))
    return spark.createDataFrame(out, "batch int, spans long, finished long")


@query("SNK-13", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, CASE WHEN n_nationkey % 4 < 2 THEN 'a' ELSE 'b' END AS symbol FROM nation")
def grammar_file(spark, sf):
    g = json.loads(sinks.grammar_json(sequence.grammar(["a" if k % 4 < 2 else "b" for k, _, _ in _nations(spark, sf)])))

    def unfold(symbol: str) -> list[str]:
        if symbol not in g["macros"]:
            return [symbol]
        _, parts, times = g["macros"][symbol]
        return [x for p in parts for x in unfold(p)] * times

    symbols = [x for name, _, _ in g["nodes"] for x in unfold(name)]
    return spark.createDataFrame(list(enumerate(symbols)), "pos long, symbol string")


@query("SNK-14", "SELECT n_name AS name FROM nation")
def spans_page(spark, sf):
    n = [(f"{k:032x}", f"{k:016x}", name, "step", "ok", k, k) for k, name, _ in _nations(spark, sf)]
    page = sinks.spans_html(spark.createDataFrame(n, "trace_id string, span_id string, name string, kind string, status string, duration_ns long, start_ns long"))
    return spark.createDataFrame([(x,) for x in re.findall(r"<tr><td>[^<]*</td><td>[^<]*</td><td>([^<]*)</td>", page)], "name string")


@query("API-01", "SELECT n_regionkey AS device_id, count(*) AS events, CAST(sum(60) AS BIGINT) AS busy_ns FROM nation GROUP BY 1")
def analysed(spark, sf):
    folder = _folder(spark)
    os.makedirs(f"{folder}/in")
    _ascend(spark, sf, f"{folder}/in")
    events = analyze(spark, f"{folder}/in", f"{folder}/out").relations["event"]
    return events.groupBy("device_id").agg(F.count("*").alias("events"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("busy_ns"))


@query("API-04")
def rules_at_hand(spark, sf):
    return spark.createDataFrame([(name, len(bundled_rules(name))) for name in ("classification", "task_symbols", "collective_symbols")], "name string, rules long")


@query("API-05", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey >= 5")
def command_line(spark, sf):
    from lodequarry.__main__ import main

    out, said = f"{_folder(spark)}/published", io.StringIO()
    sinks.publish({"lq_cli_nation": table(spark, sf, "nation")}, out)
    with contextlib.redirect_stdout(said):
        main(["query", out, "--sql", "SELECT n_name, n_regionkey FROM lq_cli_nation WHERE n_nationkey >= 5"])
    rows = [json.loads(x) for x in said.getvalue().splitlines()]
    return spark.createDataFrame([(r["n_name"], r["n_regionkey"]) for r in rows], "n_name string, n_regionkey long")
