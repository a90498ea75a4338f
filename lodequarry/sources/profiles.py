"""Profiler databases (SQLite) as DataFrames of trace relations. Tables are read in rowid ranges by tasks; columns are found by alias, absent ones are null."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold our own output are not searched.
OWN = (".lodequarry", "timeline")
# The parts of a split profile and the tables by which kinds of database are known.
SPLIT_PARTS = ("ascend_task.db", "ge_info.db", "runtime.db", "api_event.db", "hccl_single_device.db")
KINDS = (("ascend", ("TASK", "STRING_IDS")), ("cuda", ("CUPTI_ACTIVITY_KIND_KERNEL", "StringIds")), ("split", ("AscendTask",)))


def tables(db: str) -> dict[str, list[str]]:
    """Table -> columns of a database."""
    with sqlite3.connect(f"file:{db}?mode=ro", uri=True) as c:
        names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        return {n: [r[1] for r in c.execute(f'PRAGMA table_info("{n}")')] for n in names}


def kind_of(db: str) -> str | None:
    """ascend, cuda, hygon or split, by the tables present; null if none fits or the file is no database."""
    try:
        have = tables(db)
    except sqlite3.DatabaseError:
        return None
    if any(t.startswith("HIPOPS_") for t in have):
        return "hygon"
    for kind, need in KINDS:
        if all(t in have for t in need):
            return kind if kind != "ascend" or {"startNs", "endNs"} <= set(have["TASK"]) else None
    return None


def discover(root: str) -> list[tuple[str, str]]:
    """(path, kind) of the databases at or below a path, sorted; of a folder with a usable whole database, its split parts are left out."""
    if os.path.isfile(root):
        return [(root, k)] if (k := kind_of(root)) else []
    found: list[tuple[str, str]] = []
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if d not in OWN)
        here = [(os.path.join(folder, n), k) for n in sorted(names) if n.endswith((".db", ".sqlite", ".sqlite3")) and (k := kind_of(os.path.join(folder, n)))]
        whole = [x for x in here if x[1] != "split"]
        found += whole or here
    return sorted(found)


def format_label(path: str, kind: str) -> str:
    """A name for the layout of an input."""
    return {"ascend": "ascend_monolithic_sqlite", "split": "ascend_split_sqlite", "cuda": "cuda_nsys_sqlite", "hygon": "hygon_hip_sqlite"}.get(kind, Path(path).suffix.lstrip("."))


def evidence(folder: str) -> tuple[str, list[str]]:
    """State of a split profile (complete, partial or absent) and the parts it lacks."""
    have = {p.name for p in Path(folder).rglob("*.db")}
    lacking = [p for p in SPLIT_PARTS if p not in have]
    return ("complete" if not lacking else "absent" if len(lacking) == len(SPLIT_PARTS) else "partial"), lacking


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """part, table, schema, n: the tables of a split profile's databases, with their statements and row counts; files that are no database are left out."""
    rows = []
    for p in sorted(Path(folder).rglob("*.db")):
        try:
            with sqlite3.connect(f"file:{p}?mode=ro", uri=True) as c:
                for name, text in c.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                    rows.append((str(p.relative_to(folder)), name, text, c.execute(f'SELECT count(*) FROM "{name}"').fetchone()[0]))
        except sqlite3.DatabaseError:
            continue
    return spark.createDataFrame(rows, "part string, `table` string, schema string, n long")


_TYPES = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "NUMERIC": "double"}


def read_table(spark: SparkSession, db: str, table: str, parts: int = 8) -> DataFrame:
    """A table with its row_id, scanned in `parts` ranges of rowids. Tasks open the file, so it must lie where all of them see it."""
    with sqlite3.connect(f"file:{db}?mode=ro", uri=True) as c:
        cols = [(r[1], _TYPES.get((r[2] or "").upper(), "string")) for r in c.execute(f'PRAGMA table_info("{table}")')]
        low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if not cols:
        raise ValueError(f"{db} has no table {table}")
    schema = "row_id long, " + ", ".join(f"`{n}` {t}" for n, t in cols)
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)
    ranges = spark.createDataFrame([(a, min(a + step, high + 1)) for a in range(low, high + 1, step)], "a long, b long").repartition(parts, "a")
    picked = ", ".join(["rowid", *(f'"{n}"' for n, _ in cols)])
    kinds = ["long", *(t for _, t in cols)]

    def scan(batches):
        import pyarrow as pa

        of = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        make = {"long": lambda v: None if v is None else int(v), "double": lambda v: None if v is None else float(v), "string": lambda v: None if v is None else str(v)}
        with sqlite3.connect(f"file:{db}?mode=ro", uri=True) as c:
            for batch in batches:
                for a, b in zip(*(x.to_pylist() for x in batch.columns)):
                    rows = c.execute(f'SELECT {picked} FROM "{table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (a, b))
                    while chunk := rows.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([make[k](v) for v in col], of[k]) for col, k in zip(zip(*chunk), kinds)], ["row_id", *(n for n, _ in cols)])

    return ranges.mapInArrow(scan, schema)


def projected(df: DataFrame, wanted: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Columns by name, each from the first of its aliases that is there, cast to its type; null where none is."""
    have = {c.lower(): c for c in df.columns}

    def pick(names: Sequence[str], kind: str) -> Column:
        hit = next((have[n.lower()] for n in names if n.lower() in have), None)
        return F.col(f"`{hit}`").cast(kind) if hit else F.lit(None).cast(kind)

    return df.select(*(pick(names, kind).alias(out) for out, (names, kind) in wanted.items()))


def _named(df: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    n = names.select(F.col("id").alias(column), F.col("value").alias(out))
    return df.join(n, column, "left").drop(column)


_TASK = {
    "event_id": (("row_id",), "long"), "device_id": (("deviceId", "device_id"), "long"), "stream_id": (("streamId", "stream_id"), "long"), "start_ns": (("startNs", "start"), "long"), "end_ns": (("endNs", "end"), "long"),
    "connection_id": (("connectionId", "connection_id"), "long"), "task_key": (("globalTaskId",), "long"), "type_id": (("taskType",), "long"), "task_id": (("taskId", "task_id"), "long"), "context_id": (("contextId", "context_id"), "long"), "model_id": (("modelId", "model_id"), "long"),
}


def load_ascend(spark: SparkSession, db: str) -> dict[str, DataFrame]:
    """task, communication and runtime_call of a whole database; names are looked up, raw ids of -1 become null."""
    have = tables(db)
    names = read_table(spark, db, "STRING_IDS").select("id", "value")
    task = _named(projected(read_table(spark, db, "TASK"), _TASK), names, "type_id", "task_type")
    if "COMPUTE_TASK_INFO" in have:
        info = projected(read_table(spark, db, "COMPUTE_TASK_INFO"), {"task_key": (("globalTaskId",), "long"), "name": (("name",), "long"), "op": (("opType",), "long")})
        info = _named(_named(info, names, "name", "op_name"), names, "op", "op_type").groupBy("task_key").agg(F.min("op_name").alias("op_name"), F.min("op_type").alias("op_type"))
        task = task.join(info, "task_key", "left")
    if "COMMUNICATION_TASK_INFO" in have:
        info = _named(projected(read_table(spark, db, "COMMUNICATION_TASK_INFO"), {"task_key": (("globalTaskId",), "long"), "name": (("name",), "long")}), names, "name", "comm_name")
        task = task.join(info.groupBy("task_key").agg(F.min("comm_name").alias("comm_name")), "task_key", "left")
    for c in ("connection_id", "task_id", "context_id", "model_id"):
        task = task.withColumn(c, F.when(F.col(c) != -1, F.col(c)))
    out = {"task": task}
    if "COMMUNICATION_OP" in have:
        op = projected(read_table(spark, db, "COMMUNICATION_OP"), {"event_id": (("row_id",), "long"), "device_id": (("deviceId",), "long"), "start_ns": (("startNs",), "long"), "end_ns": (("endNs",), "long"), "connection_id": (("connectionId",), "long"), "name": (("opName",), "long"), "kind": (("opType",), "long")})
        out["communication"] = _named(_named(op, names, "name", "op_name"), names, "kind", "op_type")
    if "CANN_API" in have:
        call = projected(read_table(spark, db, "CANN_API"), {"call_id": (("row_id",), "long"), "start_ns": (("startNs",), "long"), "end_ns": (("endNs",), "long"), "thread_id": (("globalTid",), "long"), "connection_id": (("connectionId",), "long"), "name": (("name",), "long")})
        out["runtime_call"] = _named(call, names, "name", "api_name")
    return out


def load_cuda(spark: SparkSession, db: str) -> dict[str, DataFrame]:
    """task, communication and runtime_call of a CUDA database; kernels of collectives are communication too, and copies, sets, syncs and events are tasks of their types."""
    have = tables(db)
    names = read_table(spark, db, "StringIds").select("id", "value")
    base = {"event_id": (("row_id",), "long"), "device_id": (("deviceId",), "long"), "stream_id": (("streamId",), "long"), "start_ns": (("start",), "long"), "end_ns": (("end",), "long"), "connection_id": (("correlationId",), "long"), "graph_node_id": (("graphNodeId",), "long"), "name": (("shortName", "demangledName", "nameId"), "long")}
    kernel = _named(projected(read_table(spark, db, "CUPTI_ACTIVITY_KIND_KERNEL"), base), names, "name", "op_name")
    collective = F.coalesce(F.lower("op_name").contains("nccl"), F.lit(False))
    task = kernel.withColumn("task_type", F.when(collective, "CUDA_COLLECTIVE_KERNEL").otherwise("CUDA_KERNEL"))
    for t, kind in (("MEMCPY", "CUDA_MEMCPY_AUX"), ("MEMSET", "CUDA_MEMCPY_AUX"), ("SYNCHRONIZATION", "CUDA_SYNC_AUX"), ("CUDA_EVENT", "CUDA_EVENT_AUX")):
        if f"CUPTI_ACTIVITY_KIND_{t}" in have:
            more = projected(read_table(spark, db, f"CUPTI_ACTIVITY_KIND_{t}"), base).drop("name").withColumns({"op_name": F.lit(t), "task_type": F.lit(kind)})
            task = task.unionByName(more, allowMissingColumns=True)
    out = {"task": task, "communication": kernel.where(collective)}
    if "CUPTI_ACTIVITY_KIND_RUNTIME" in have:
        call = projected(read_table(spark, db, "CUPTI_ACTIVITY_KIND_RUNTIME"), {"call_id": (("row_id",), "long"), "start_ns": (("start",), "long"), "end_ns": (("end",), "long"), "thread_id": (("globalTid",), "long"), "connection_id": (("correlationId",), "long"), "name": (("nameId",), "long")})
        out["runtime_call"] = _named(call, names, "name", "api_name")
    if "CUPTI_ACTIVITY_KIND_GRAPH_TRACE" in have:
        out["graph_trace"] = projected(read_table(spark, db, "CUPTI_ACTIVITY_KIND_GRAPH_TRACE"), base).drop("name")
    return out


def load_hygon(spark: SparkSession, db: str) -> dict[str, DataFrame]:
    """task of a HIP database: all operation and copy tables; rows that end no later than they begin are dropped."""
    have = tables(db)
    names = read_table(spark, db, "STR_TABLE").select(F.col("STR_ID").alias("id"), F.col("STR_NAME").alias("value")) if "STR_TABLE" in have else None
    base = {"event_id": (("row_id",), "long"), "device_id": (("dev_id",), "long"), "stream_id": (("queue_id",), "long"), "start_ns": (("BeginNs",), "long"), "end_ns": (("EndNs",), "long"), "connection_id": (("_Index",), "long"), "name": (("Name", "Kind"), "long")}
    task = None
    for t in sorted(t for t in have if t.startswith(("HIPOPS_", "HIPCOPY_"))):
        part = projected(read_table(spark, db, t), base).withColumns({"task_type": F.lit("HIP_KERNEL" if t.startswith("HIPOPS_") else "MEMCPY"), "source_table": F.lit(t)})
        task = part if task is None else task.unionByName(part)
    if task is None:
        raise ValueError(f"{db} has no operation tables")
    task = task.where("end_ns > start_ns")
    return {"task": _named(task, names, "name", "op_name") if names is not None else task.drop("name")}


def load_split(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """task, communication and runtime_call of a profile split over many databases, in the columns of a whole one."""
    parts: dict[str, list[str]] = {}
    for p in sorted(Path(folder).rglob("*.db")):
        try:
            for t in tables(str(p)):
                parts.setdefault(t, []).append(str(p))
        except sqlite3.DatabaseError:
            continue

    def all_of(table: str, wanted) -> DataFrame | None:
        out = None
        for p in parts.get(table, []):
            df = projected(read_table(spark, p, table), wanted)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    task = all_of("AscendTask", {"event_id": (("row_id",), "long"), "device_id": (("device_id",), "long"), "stream_id": (("stream_id",), "long"), "task_id": (("task_id",), "long"), "context_id": (("context_id",), "long"), "start_ns": (("start_time",), "long"), "dur": (("duration",), "long"), "connection_id": (("connection_id",), "long"), "host_type": (("host_task_type",), "string"), "device_type": (("device_task_type",), "string")})
    if task is None:
        raise ValueError(f"{folder} holds no device tasks")
    task = task.select("event_id", "device_id", "stream_id", "task_id", "context_id", "start_ns", (F.col("start_ns") + F.col("dur")).alias("end_ns"), "connection_id", F.coalesce("host_type", "device_type").alias("task_type"))
    info = all_of("TaskInfo", {"stream_id": (("stream_id",), "long"), "task_id": (("task_id",), "long"), "op_name": (("op_name",), "string"), "op_type": (("op_type",), "string")})
    if info is not None:
        task = task.join(info.groupBy("stream_id", "task_id").agg(F.min("op_name").alias("op_name"), F.min("op_type").alias("op_type")), ["stream_id", "task_id"], "left")
    out = {"task": task}
    comm = all_of("HCCLOP", {"event_id": (("row_id",), "long"), "device_id": (("device_id",), "long"), "start_ns": (("begin",), "long"), "end_ns": (("end",), "long"), "connection_id": (("connection_id",), "long"), "op_name": (("op_name",), "string"), "op_type": (("op_type",), "string")})
    if comm is not None:
        out["communication"] = comm
    call = all_of("ApiData", {"call_id": (("row_id",), "long"), "start_ns": (("start",), "long"), "end_ns": (("end",), "long"), "connection_id": (("connection_id",), "long"), "api_name": (("id",), "string")})
    if call is not None:
        out["runtime_call"] = call
    return out


LOADERS = {"ascend": load_ascend, "cuda": load_cuda, "hygon": load_hygon}


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of one database, or of a folder with a split profile."""
    if os.path.isdir(path):
        return load_split(spark, path)
    kind = kind_of(path)
    if kind not in LOADERS:
        raise ValueError(f"{path} is not a profile this engine reads")
    return LOADERS[kind](spark, path)
