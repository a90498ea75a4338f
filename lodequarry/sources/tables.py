"""Trace relations derived from the plain tables, so that every operator runs on them as on profiler rows.

Times are long nanoseconds throughout: timestamps of Spark hold microseconds only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event type that plays the collective, and the one that plays the wait.
COMMUNICATION, WAIT = "purchase", "error"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_ns(column: str) -> Column:
    """Nanoseconds of a wall-clock timestamp (with or without a zone) since 1970, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())) * 1000


def trace_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device intervals: event_id, device_id, stream_id, start_ns, end_ns, symbol."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 4).alias("device_id"),
        (F.col("user_id") % 16).alias("stream_id"),
        (wall_ns("ts")).alias("start_ns"),
        (wall_ns("ts") + F.round(F.col("value") * 100).cast("long") * 100_000_000).alias("end_ns"),
        F.col("event_type").alias("symbol"),
    )


#: The same in DuckDB's SQL.
TRACE_EVENT = """(SELECT event_id, user_id % 4 AS device_id, user_id % 16 AS stream_id, epoch_us(ts) * 1000 AS start_ns,
 epoch_us(ts) * 1000 + CAST(round(value * 100) AS BIGINT) * 100000000 AS end_ns, event_type AS symbol FROM events)"""


def runtime_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host calls: call_id, process_id, thread_id, start_ns, end_ns, api_name, correlation_id."""
    t = wall_ns("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        (F.col("o_custkey") % 3).alias("process_id"),
        (F.col("o_custkey") % 7).alias("thread_id"),
        (t + F.col("o_orderkey") % 86_400 * 1_000_000_000).alias("start_ns"),
        (t + F.col("o_orderkey") % 86_400 * 1_000_000_000 + F.round(F.col("o_totalprice")).cast("long") * 1_000_000).alias("end_ns"),
        F.concat(F.lit("api"), F.col("o_orderpriority")).alias("api_name"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("correlation_id"),
    )


RUNTIME_CALL = """(SELECT o_orderkey AS call_id, o_custkey % 3 AS process_id, o_custkey % 7 AS thread_id,
 epoch_us(o_orderdate) * 1000 + o_orderkey % 86400 * 1000000000 AS start_ns,
 epoch_us(o_orderdate) * 1000 + o_orderkey % 86400 * 1000000000 + CAST(round(o_totalprice) AS BIGINT) * 1000000 AS end_ns,
 'api' || o_orderpriority AS api_name, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey - o_orderkey % 2 END AS correlation_id FROM orders)"""


def device_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device work units: work_id, device_id, start_ns, end_ns, correlation_id."""
    t = wall_ns("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("work_id"),
        (F.col("l_suppkey") % 4).alias("device_id"),
        t.alias("start_ns"),
        (t + F.round(F.col("l_quantity")).cast("long") * 1_000_000_000).alias("end_ns"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_orderkey")).alias("correlation_id"),
    )


DEVICE_WORK = """(SELECT l_orderkey * 8 + l_linenumber AS work_id, l_suppkey % 4 AS device_id, epoch_us(l_shipdate) * 1000 AS start_ns,
 epoch_us(l_shipdate) * 1000 + CAST(round(l_quantity) AS BIGINT) * 1000000000 AS end_ns,
 CASE WHEN l_partkey % 13 <> 0 THEN l_orderkey END AS correlation_id FROM lineitem)"""


def tree_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child of the tree world, regions, nations, customers."""
    region = table(spark, sf_dir, "region").select(F.lit("world").alias("parent"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("child"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.concat(F.lit("c"), F.col("c_custkey")).alias("child"))
    return region.union(nation).union(customer)


TREE_EDGE = """(SELECT 'world' AS parent, 'r' || r_regionkey AS child FROM region
 UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""
