"""Inference logs: newline-delimited JSON, checked line by line, and imported again and again without repeating an event."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The events of a log and the fields of their envelope.
TYPES = ("span_start", "span_end", "span_event", "trace_end", "metrics")
REQUIRED = ("schema_version", "event_id", "trace_id", "span_id", "producer_id", "clock_id", "sequence", "event_type", "wall_time_ns", "monotonic_ns")
OPTIONAL = ("parent_span_id", "name", "kind", "status", "attributes", "links", "evidence_refs", "decision_summary")
LONGEST_LINE = 16 * 1024
MOST_EVENTS = 100_000

EVENT = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("span_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("producer_id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("at_ns", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("error", T.StringType())])


def _once(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise ValueError("a key is repeated")
    return dict(pairs)


def check(line: str) -> tuple:
    """A line as (trace, event, span, type, producer, sequence, time, canonical JSON, null), or nulls and what is wrong with it."""
    try:
        if len(line.encode()) > LONGEST_LINE:
            raise ValueError("the line is too long")
        e = json.loads(line, object_pairs_hook=_once)
        if not isinstance(e, dict):
            raise ValueError("not an object")
        if lacking := [k for k in REQUIRED if k not in e]:
            raise ValueError(f"missing: {', '.join(lacking)}")
        if strange := sorted(set(e) - set(REQUIRED) - set(OPTIONAL)):
            raise ValueError(f"unknown: {', '.join(strange)}")
        if e["event_type"] not in TYPES:
            raise ValueError("unknown event type")
        for k, digits in (("trace_id", 32), ("span_id", 16)):
            if not isinstance(e[k], str) or not re.fullmatch(f"[0-9a-f]{{{digits}}}", e[k]) or not e[k].strip("0"):
                raise ValueError(f"{k} is not an id")
        for k in ("sequence", "wall_time_ns", "monotonic_ns", "schema_version"):
            if not isinstance(e[k], int) or isinstance(e[k], bool) or not 0 <= e[k] < 1 << 63:
                raise ValueError(f"{k} is not a count")
        return e["trace_id"], str(e["event_id"]), e["span_id"], e["event_type"], str(e["producer_id"]), e["sequence"], e["monotonic_ns"], json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None
    except (ValueError, UnicodeError) as x:
        return None, None, None, None, None, None, None, None, str(x)


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines as events; a line that is not one keeps its error and nulls beside it."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in EVENT]
        for batch in batches:
            rows = [check(x or "") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], EVENT.names) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], EVENT.names)

    return lines.select(column).mapInArrow(run, EVENT)


def span_events(events: DataFrame) -> DataFrame:
    """Events in the columns that context.spans reads."""
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    return events.select("trace_id", "span_id", "event_id", "event_type", "producer_id", j("clock_id").alias("clock_id"), "sequence", "at_ns", j("parent_span_id").alias("parent_span_id"), j("name").alias("name"), j("kind").alias("kind"), j("status").alias("status"))


class ConflictError(ValueError):
    """An event that was imported before with other contents."""


def import_batch(store: str, lines: DataFrame) -> dict[str, int]:
    """Append the events of some lines to a Parquet store that holds each (trace_id, event_id) once.

    All or nothing: an invalid line, a known event with other contents, or more events than allowed raise and leave the store as it was. A batch given again adds nothing."""
    spark = lines.sparkSession
    fresh = parsed(lines).persist()
    try:
        wrong = fresh.where("error is not null").select("error").first()
        if wrong:
            raise ValueError(wrong[0])
        events = fresh.drop("error").dropDuplicates(["trace_id", "event_id", "payload"])
        if events.groupBy("trace_id", "event_id").count().where("count > 1").first():
            raise ConflictError("one event has two contents in a batch")
        seen, given = events.count(), fresh.count()
        try:
            known = spark.read.schema(events.schema).parquet(store)
            had = known.count()
        except Exception as x:  # noqa: BLE001  the store does not exist yet
            if "PATH_NOT_FOUND" not in str(x):
                raise
            known, had = spark.createDataFrame([], events.schema), 0
        met = events.join(known.select("trace_id", "event_id", F.col("payload").alias("old")), ["trace_id", "event_id"])
        if met.where("old <> payload").first():
            raise ConflictError("an event was imported before with other contents")
        new = events.join(known.select("trace_id", "event_id"), ["trace_id", "event_id"], "left_anti")
        n = new.count()
        if had + n > MOST_EVENTS:
            raise ValueError(f"the store would hold over {MOST_EVENTS} events")
        if n:
            new.write.mode("append").parquet(store)
        return {"lines": given, "new": n, "known": seen - n, "repeated": given - seen}
    finally:
        fresh.unpersist()


def complete_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The complete lines of a file that may still grow, and the bytes of the unfinished line behind them."""
    data = spark.sparkContext.binaryFiles(path).first()[1]
    end = data.rfind(b"\n") + 1
    return spark.createDataFrame([(x,) for x in data[:end].decode().split("\n")[:-1]], "value string"), len(data) - end
