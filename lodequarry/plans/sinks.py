"""Outputs: a folder of Parquet tables published at once, traces for the Perfetto viewer, and bounded Markdown and HTML."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(relations: Mapping[str, DataFrame], out: str, sources: tuple[str, ...] = ()) -> None:
    """Write every relation below a staging folder and rename it to `out`; readers see all of it or nothing.

    ValueError if `out` exists or is one of the sources."""
    spark = next(iter(relations.values())).sparkSession
    target, fs = _fs(spark, out)
    if out in sources or fs.exists(target):
        raise ValueError(f"{out} is there already")
    staging, _ = _fs(spark, f"{out.rstrip('/')}.staging-{uuid.uuid4().hex}")
    try:
        for name, df in relations.items():
            df.write.parquet(f"{staging.toString()}/{name}")
        if not fs.rename(staging, target):
            raise ValueError(f"{out} could not be published")
    finally:
        fs.delete(staging, True)


def opened(spark: SparkSession, folder: str, prefix: str = "") -> dict[str, DataFrame]:
    """The relations of a published folder, each also as a temporary view of its name."""
    path, fs = _fs(spark, folder)
    out = {}
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        out[name] = spark.read.parquet(f"{folder}/{name}")
        out[name].createOrReplaceTempView(prefix + name)
    return out


def perfetto_rows(events: DataFrame, process: str = "device_id", thread: str = "stream_id", name: str = "symbol") -> DataFrame:
    """Complete slices as JSON lines of the trace-event format: times in microseconds, to the nanosecond, as text keeps all digits."""
    us = lambda c: F.concat(F.expr(f"({c}) div 1000").cast("string"), F.lit("."), F.lpad(F.expr(f"({c}) % 1000").cast("string"), 3, "0"))
    text = F.to_json(F.struct(F.col(name).cast("string").alias("name"), F.lit("X").alias("ph"), F.col(process).cast("long").alias("pid"), F.col(thread).cast("long").alias("tid")))
    rows = events.select("start_ns", text.alias("j"), us("start_ns").alias("ts"), us("end_ns - start_ns").alias("dur"))
    return rows.select("start_ns", F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"ts":'), "ts", F.lit(',"dur":'), "dur", F.lit("}")).alias("value"))


def write_perfetto(events: DataFrame, out: str, compress: bool = False, **names: str) -> None:
    """A folder of text parts: the first begins the JSON array, each slice ends with a comma, as viewers accept an array that is not closed."""
    rows = perfetto_rows(events, **names)
    head = events.sparkSession.createDataFrame([(None, "[")], "start_ns long, value string")
    lines = head.union(rows.select("start_ns", F.concat("value", F.lit(",")))).repartitionByRange(F.col("start_ns").asc_nulls_first()).sortWithinPartitions(F.col("start_ns").asc_nulls_first()).select("value")
    lines.write.option("compression", "gzip" if compress else "none").text(out)


def raw_lanes(tables: Mapping[str, tuple[DataFrame, str | None, str | None]]) -> DataFrame:
    """Rows of raw provider tables as slices: lane, pid, tid (0 where the table has no such column), start_ns, end_ns, source (the row as JSON).

    tables: name -> rows, column of the process, column of the thread. Start and end go by startNs and endNs, or start and end; rows without a start have no place and are left out."""
    out = None
    for name, (df, process, thread) in tables.items():
        start, end = ("startNs", "endNs") if "startNs" in df.columns else ("start", "end")
        at = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c else F.lit(0).cast("long")
        part = df.where(F.col(start).isNotNull()).select(F.lit(f"raw:{name}").alias("lane"), at(process).alias("pid"), at(thread).alias("tid"), F.col(start).cast("long").alias("start_ns"), F.col(end).cast("long").alias("end_ns"), F.to_json(F.struct(*df.columns)).alias("source"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables are given")
    return out


def clock_models(spark: SparkSession, path: str) -> DataFrame:
    """Clock models of ranks from JSON lines (rank, slope_ppb, intercept_ns, reference_ns), as `aligned` takes them. ValueError on a line that is none, a rank that is missing or told twice."""
    schema = "rank long, slope_ppb long, intercept_ns long, reference_ns long, bad string"
    models = spark.read.schema(schema).option("columnNameOfCorruptRecord", "bad").json(path)
    rows = models.collect()  # a row per rank
    if any(r["bad"] is not None or any(r[c] is None for c in ("rank", "slope_ppb", "intercept_ns", "reference_ns")) for r in rows):
        raise ValueError("a line is no clock model")
    if len({r["rank"] for r in rows}) < len(rows):
        raise ValueError("a rank has two clock models")
    return spark.createDataFrame([tuple(r)[:4] for r in rows], "rank long, slope_ppb long, intercept_ns long, reference_ns long")


def aligned(events: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """Events of several ranks on one axis by an affine model per rank (slope_ppb, intercept_ns, reference_ns); a rank without a model starts at its first event."""
    first = events.groupBy(key).agg(F.min("start_ns").alias("_first"))
    met = events.join(first, key).join(models, key, "left")
    at = lambda c: F.coalesce(F.col("intercept_ns") + (F.col(c) - F.col("reference_ns")) + F.round((F.col(c) - F.col("reference_ns")) * F.col("slope_ppb") / 1e9).cast("long"), F.col(c) - F.col("_first"))
    return met.select(*[c for c in events.columns if c not in ("start_ns", "end_ns")], at("start_ns").alias("start_ns"), at("end_ns").alias("end_ns"))


def tree_markdown(tree: DataFrame, most: int = 5_000, expanded: bool = False) -> str:
    """A tree (node, parent, depth, path, ...) as nested Markdown, at most this many nodes; compact shows inner nodes alone. ValueError if there are more."""
    shown = tree if expanded else tree.join(tree.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
    rows = shown.select("node", "depth", "path").orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the tree has over {most} nodes to show")
    return "\n".join(f"{'  ' * r['depth']}- {r['node']}" for r in rows) + "\n"


def spans_html(spans: DataFrame, most: int = 2_000) -> str:
    """A table of spans, at most this many, the earliest first, with a note if there are more."""
    rows = spans.orderBy("trace_id", "start_ns", "span_id").limit(most + 1).collect()
    cells = lambda r: "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in ("trace_id", "span_id", "name", "kind", "status", "duration_ns"))
    note = "<p>More spans are not shown.</p>" if len(rows) > most else ""
    return "<!doctype html><meta charset=utf-8><table>" + "".join(f"<tr>{cells(r)}</tr>" for r in rows[:most]) + f"</table>{note}"


def grammar_json(grammar) -> str:
    """A folded sequence with its macros and steps, for inspection."""
    return json.dumps({"status": grammar.status, "nodes": grammar.nodes, "macros": {k: [m.kind, list(m.parts), m.times] for k, m in grammar.macros.items()}, "steps": grammar.steps}, indent=1)
