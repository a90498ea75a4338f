"""Queries for replay reconstruction, marked segments and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodequarry.operators import intervals as I
from lodequarry.operators import replay as P
from lodequarry.plans.core_queries import EV
from lodequarry.plans.registry import query
from lodequarry.sources.tables import COMMUNICATION, RUNTIME_CALL, WAIT, device_work, runtime_call, table, trace_event, wall_ns

_BODY = "SELECT o_orderkey, o_custkey, sha256(string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_returnflag)) AS template FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


def _bodies(spark, sf):
    return table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("REP-07", f"""WITH b AS ({_BODY}), n AS (SELECT o_custkey, count(DISTINCT template) AS k FROM b GROUP BY 1)
 SELECT o_orderkey, o_custkey, template, count(*) OVER (PARTITION BY template) AS repeats, CASE WHEN k > 1 THEN 'several_bodies' WHEN count(*) OVER (PARTITION BY template) < 2 THEN 'few_repeats' ELSE 'exact' END AS state FROM b JOIN n USING (o_custkey)""")
def exact_units(spark, sf):
    return P.exact_units(_bodies(spark, sf), "o_orderkey", "o_custkey", ["l_linenumber"], "l_returnflag")


@query("REP-10", f"""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - o_orderkey % 12 ELSE -o_orderkey END AS graph, sha256(string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_returnflag)) AS template FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), n AS (SELECT graph, count(DISTINCT template) AS k FROM b GROUP BY 1),
 s AS (SELECT graph, k, count(*) OVER (PARTITION BY template) AS r FROM b JOIN n USING (graph)) SELECT CASE WHEN k > 1 THEN 'several_bodies' WHEN r < 2 THEN 'few_repeats' ELSE 'exact' END AS state, count(*) AS launches FROM s GROUP BY 1""")
def graph_replays(spark, sf):
    x = _bodies(spark, sf).withColumn("graph", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - o_orderkey % 12 ELSE -o_orderkey END"))
    return P.exact_units(x, "o_orderkey", "graph", ["l_linenumber"], "l_returnflag").groupBy("state").agg(F.count("*").alias("launches"))


@query("CST-08", """WITH m AS (SELECT l_orderkey AS u, epoch_us(l_shipdate) * 1000 AS a, epoch_us(l_shipdate) * 1000 + CAST(round(l_quantity) AS BIGINT) * 1000000000 AS b, l_discount > 0 AS resolved FROM lineitem),
 s AS (SELECT u, count(*) AS n, bool_and(resolved) AS r FROM m GROUP BY 1), p AS (SELECT *, max(b) OVER (PARTITION BY u ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM m),
 c AS (SELECT u, CAST(sum(greatest(0, b - greatest(a, coalesce(prior, a)))) AS BIGINT) AS union_ns, CAST(sum(b - a) AS BIGINT) AS sum_ns, max(b) - min(a) AS envelope_ns FROM p GROUP BY 1),
 x AS (SELECT o_orderkey, CASE WHEN n IS NULL THEN 'no_members' WHEN NOT r THEN 'unresolved_member' WHEN n < 4 THEN 'missing_members' WHEN n > 4 THEN 'surplus_members' END AS reason, c.* FROM orders LEFT JOIN s ON s.u = o_orderkey LEFT JOIN c ON c.u = o_orderkey)
 SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN union_ns END AS union_ns, CASE WHEN reason IS NULL THEN sum_ns END AS sum_ns, CASE WHEN reason IS NULL THEN envelope_ns END AS envelope_ns FROM x""")
def unit_costs(spark, sf):
    x = table(spark, sf, "lineitem")
    m = x.select(F.col("l_orderkey").alias("o_orderkey"), wall_ns("l_shipdate").alias("start_ns"), (wall_ns("l_shipdate") + F.round("l_quantity").cast("long") * 1_000_000_000).alias("end_ns"), (F.col("l_discount") > 0).alias("resolved"))
    return P.unit_costs(table(spark, sf, "orders").select("o_orderkey", F.lit(4).alias("expected")), m, "o_orderkey", "expected")


@query("REP-06", f"""WITH l AS (SELECT call_id, thread_id, process_id, start_ns, correlation_id, bool_and(correlation_id IS NOT NULL) OVER (PARTITION BY thread_id, process_id) AS whole FROM {RUNTIME_CALL})
 SELECT call_id, row_number() OVER (PARTITION BY thread_id, process_id ORDER BY CASE WHEN whole THEN correlation_id ELSE start_ns END, call_id) - 1 AS position, CASE WHEN whole THEN 'host_submission' ELSE 'device_time' END AS order_basis FROM l""")
def launch_order(spark, sf):
    return P.chosen_order(runtime_call(spark, sf), ["thread_id", "process_id"], "correlation_id", "start_ns", "call_id").select("call_id", F.col("position").cast("long").alias("position"), "order_basis")


@query("REP-12", f"""SELECT c.call_id AS launch_id, w.work_id AS member_id, row_number() OVER (PARTITION BY c.call_id ORDER BY w.start_ns, w.work_id, w.device_id) - 1 AS task_ordinal FROM {RUNTIME_CALL} c JOIN (SELECT l_orderkey * 8 + l_linenumber AS work_id, l_orderkey, l_suppkey % 4 AS device_id, epoch_us(l_shipdate) * 1000 AS start_ns FROM lineitem) w ON w.l_orderkey = c.call_id WHERE c.correlation_id IS NOT NULL""")
def launch_members(spark, sf):
    w = device_work(spark, sf).withColumn("call_id", F.expr("(work_id - pmod(work_id, 8)) div 8"))
    c, w = runtime_call(spark, sf).where("correlation_id is not null").select("call_id"), w.select("call_id", "work_id", "start_ns", "device_id")
    n = I.tasks(c, w)
    met = c.repartition(n, "call_id").join(w.repartition(n, "call_id"), "call_id")
    order = Window.partitionBy("call_id").orderBy("start_ns", "work_id", "device_id")
    return met.select(F.col("call_id").alias("launch_id"), F.col("work_id").alias("member_id"), (F.row_number().over(order).cast("long") - 1).alias("task_ordinal"))


_IDX = f"(SELECT event_id, device_id, symbol, row_number() OVER (PARTITION BY device_id ORDER BY start_ns, end_ns, event_id) AS anchor_idx FROM {EV})"


@query("REP-13", f"""WITH r AS (SELECT event_id AS region_id, device_id, anchor_idx AS a, anchor_idx + event_id % 4 AS b FROM {_IDX} WHERE symbol = '{COMMUNICATION}'), n AS (SELECT x.event_id, count(r.region_id) AS n, min(r.region_id) AS region_id FROM {_IDX} x LEFT JOIN r ON r.device_id = x.device_id AND x.anchor_idx BETWEEN r.a AND r.b GROUP BY 1)
 SELECT event_id, CASE WHEN n = 1 THEN region_id END AS region_id, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS annotation FROM n""")
def annotated_timeline(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "end_ns", "event_id")
    a = trace_event(spark, sf).select("event_id", "device_id", "symbol", F.row_number().over(w).cast("long").alias("anchor_idx"))
    r = a.where(F.col("symbol") == COMMUNICATION).select("device_id", F.col("event_id").alias("region_id"), F.col("anchor_idx").alias("first_idx"), (F.col("anchor_idx") + F.col("event_id") % 4).alias("last_idx"))
    return P.annotated(a, r, ["device_id"]).select("event_id", "region_id", "annotation")


@query("RUL-09", f"""WITH s AS (SELECT *, coalesce(sum(CASE WHEN symbol = '{COMMUNICATION}' THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY start_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM {EV})
 SELECT device_id, CAST(segment AS BIGINT) AS segment, count(*) AS tokens, min(CASE WHEN symbol IN ('view', 'click') THEN symbol END) AS label, bool_or(symbol = '{COMMUNICATION}') AS closed FROM s GROUP BY 1, 2""")
def marked_structure(spark, sf):
    label = F.when(F.col("symbol").isin("view", "click"), F.col("symbol"))
    return P.marked_segments(trace_event(spark, sf), ["device_id"], ["start_ns", "event_id"], F.col("symbol") == COMMUNICATION, label)


@query("CTX-08", f"""WITH a AS (SELECT event_id AS anchor_id, device_id, event_id % 50 AS step_id FROM {EV} WHERE symbol <> '{WAIT}' UNION SELECT event_id, device_id, stream_id FROM {EV} WHERE symbol = '{COMMUNICATION}')
 SELECT anchor_id, device_id, min(step_id) AS step_id FROM a GROUP BY 1, 2 HAVING count(DISTINCT step_id) = 1""")
def anchors_in_step(spark, sf):
    e = trace_event(spark, sf)
    a = e.where(F.col("symbol") != WAIT).select(F.col("event_id").alias("anchor_id"), "device_id", (F.col("event_id") % 50).alias("step_id"))
    both = a.union(e.where(F.col("symbol") == COMMUNICATION).select("event_id", "device_id", "stream_id")).distinct()
    return both.groupBy("anchor_id", "device_id").agg(F.min("step_id").alias("step_id"), F.count_distinct("step_id").alias("n")).where("n = 1").drop("n")


@query("WIN-03", f"SELECT event_id, row_number() OVER (PARTITION BY stream_id, symbol ORDER BY start_ns, end_ns, event_id) - 1 AS k FROM {EV} WHERE end_ns > start_ns")
def per_bubble(spark, sf):
    w = Window.partitionBy("stream_id", "symbol").orderBy("start_ns", "end_ns", "event_id")
    return trace_event(spark, sf).where("end_ns > start_ns").select("event_id", (F.row_number().over(w).cast("long") - 1).alias("k"))


@query("SORT-03", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part")
def by_priority(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")).cast("long").alias("k"))


@query("SORT-07", "SELECT count(*) AS fetched, count(*) > 1000 AS exceeded FROM (SELECT * FROM lineitem LIMIT 1001)")
def row_guard(spark, sf):
    return table(spark, sf, "lineitem").limit(1001).agg(F.count("*").alias("fetched"), (F.count("*") > 1000).alias("exceeded"))


@query("SET-03", "WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 60) SELECT CAST(n AS BIGINT) AS n FROM t")
def recursion(spark, sf):
    return spark.sql("WITH RECURSIVE t(n) AS (SELECT 1L UNION ALL SELECT n + 1 FROM t WHERE n < 60) SELECT n FROM t")


@query("SRC-02", "SELECT page_id, CASE WHEN contains(url, '?') THEN 'query' WHEN url LIKE '%.html' THEN 'html' WHEN url LIKE '%/' THEN 'folder' ELSE 'plain' END AS format FROM pages")
def format_labels(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.when(u.contains("?"), "query").when(u.endswith(".html"), "html").when(u.endswith("/"), "folder").otherwise("plain").alias("format"))


@query("SEQ-16", f"""WITH h AS (SELECT event_id, device_id, row_number() OVER (PARTITION BY device_id ORDER BY start_ns, event_id) AS a, row_number() OVER (PARTITION BY device_id ORDER BY end_ns, event_id) AS b FROM {EV}) SELECT event_id, a AS device_pos, b AS host_pos, CASE WHEN a = b THEN 'kept' ELSE 'moved' END AS evidence FROM h""")
def order_evidence(spark, sf):
    pos = lambda c: F.row_number().over(Window.partitionBy("device_id").orderBy(c, "event_id")).cast("long")
    h = trace_event(spark, sf).select("event_id", pos("start_ns").alias("device_pos"), pos("end_ns").alias("host_pos"))
    return h.withColumn("evidence", F.when(F.col("device_pos") == F.col("host_pos"), "kept").otherwise("moved"))


@query("STR-06", "SELECT role, count(*) AS events, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) > 100000 OR sum(strlen(text)) > 67108864 AS over_limit FROM conversations GROUP BY 1")
def size_limits(spark, sf):
    n = F.sum(F.octet_length("text"))
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("events"), n.alias("bytes"), ((F.count("*") > 100_000) | (n > 64 << 20)).alias("over_limit"))


@query("API-06")
def recipe_catalog(spark, sf):
    from lodequarry.plans import recipes

    return recipes.catalog(spark)


@query("API-07")
def continuation_catalog(spark, sf):
    from lodequarry.plans import recipes

    return recipes.continuations(spark)


@query("API-08")
def surface_catalog(spark, sf):
    from lodequarry.plans import recipes

    return recipes.surfaces(spark)


@query("SNK-06")
def perfetto_rows(spark, sf):
    from lodequarry.plans import sinks

    return sinks.perfetto_rows(trace_event(spark, sf))


@query("SNK-09", f"SELECT event_id, start_ns - min(start_ns) OVER (PARTITION BY device_id) AS start_ns, end_ns - min(start_ns) OVER (PARTITION BY device_id) AS end_ns FROM {EV}")
def aligned_ranks(spark, sf):
    from lodequarry.plans import sinks

    none = spark.createDataFrame([], "device_id long, slope_ppb long, intercept_ns long, reference_ns long")
    return sinks.aligned(trace_event(spark, sf), none, "device_id").select("event_id", "start_ns", "end_ns")

