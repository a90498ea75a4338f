"""Queries for projections, joins, aggregates, windows, sorts, sets and intervals, over the trace relations of the plain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodequarry.functions import scalars as S
from lodequarry.operators import intervals as I
from lodequarry.operators import relations as R
from lodequarry.plans.registry import query
from lodequarry.sources.tables import (
    COMMUNICATION, DEVICE_WORK, RUNTIME_CALL, TRACE_EVENT, TREE_EDGE, WAIT, device_work, runtime_call, table, trace_event, tree_edge,
)

EV = TRACE_EVENT
_COMM = f"(SELECT * FROM {EV} WHERE symbol = '{COMMUNICATION}')"
_BUSY_SQL = """WITH e AS ({src}), p AS (SELECT *, max(end_ns) OVER (PARTITION BY {keys} ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM e)
SELECT {keys}, count(*) AS intervals, CAST(sum(greatest(0, end_ns - greatest(start_ns, coalesce(prior, start_ns)))) AS BIGINT) AS union_ns,
 CAST(sum(end_ns - start_ns) AS BIGINT) AS sum_ns, max(end_ns) - min(start_ns) AS envelope_ns FROM p GROUP BY {keys}"""


@query("AGG-10", _BUSY_SQL.format(src=f"SELECT * FROM {EV}", keys="device_id"))
def busy_time(spark, sf):
    return I.busy(trace_event(spark, sf), ["device_id"])


@query("AGG-10-binned", "SELECT device_id, union_ns FROM (" + _BUSY_SQL.format(src=f"SELECT * FROM {EV}", keys="device_id") + ")")
def busy_time_binned(spark, sf):
    return I.busy_binned(trace_event(spark, sf), ["device_id"])


@query("AGG-11", _BUSY_SQL.format(src=f"SELECT * FROM {EV}", keys="device_id, stream_id, symbol"))
def envelope_lens(spark, sf):
    return I.busy(trace_event(spark, sf), ["device_id", "stream_id", "symbol"])


@query("WIN-08", f"""SELECT event_id, max(end_ns) OVER (PARTITION BY device_id ORDER BY start_ns, end_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier_ns FROM {EV}""")
def frontier(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "end_ns", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return trace_event(spark, sf).select("event_id", F.max("end_ns").over(w).alias("frontier_ns"))


@query("WIN-10", f"""SELECT event_id, max(end_ns) OVER (PARTITION BY device_id ORDER BY start_ns, end_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_end_ns FROM {EV}""")
def prefix_max(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "end_ns", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return trace_event(spark, sf).select("event_id", F.max("end_ns").over(w).alias("max_end_ns"))


@query("PRJ-01", """SELECT l_orderkey AS id, l_linenumber AS line, coalesce(CASE WHEN l_returnflag = 'R' THEN l_linestatus END, CASE WHEN l_linestatus = 'O' THEN l_returnflag END, 'raw') AS symbol,
 CASE WHEN l_returnflag = 'A' THEN 'comm' WHEN l_linestatus = 'F' THEN 'aux' ELSE 'compute' END AS role FROM lineitem""")
def event_projection(spark, sf):
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.coalesce(F.when(r == "R", s), F.when(s == "O", r), F.lit("raw")).alias("symbol"),
        F.when(r == "A", "comm").when(s == "F", "aux").otherwise("compute").alias("role"),
    )


@query("PRJ-02", f"""SELECT row_number() OVER (PARTITION BY device_id ORDER BY start_ns, end_ns, stream_id, symbol, event_id) AS anchor_idx, event_id, device_id, symbol,
 (end_ns - start_ns) / 1000.0 AS dur_us FROM {EV} WHERE symbol <> '{WAIT}'""")
def anchor_projection(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "end_ns", "stream_id", "symbol", "event_id")
    return trace_event(spark, sf).where(F.col("symbol") != WAIT).select(F.row_number().over(w).cast("long").alias("anchor_idx"), "event_id", "device_id", "symbol", ((F.col("end_ns") - F.col("start_ns")) / 1000.0).alias("dur_us"))


@query("PRJ-03", "SELECT p_partkey, trim(regexp_replace(upper(p_type || ' / ' || p_name), '[^A-Z0-9]+', '_', 'g'), '_') AS task_key FROM part")
def key_normalisation(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.task_key(F.concat("p_type", F.lit(" / "), "p_name")).alias("task_key"))


_NAME = "CASE o_orderkey % 13 WHEN 0 THEN 'cudaStreamWaitEvent' WHEN 1 THEN 'aclrtSynchronizeDevice' WHEN 2 THEN 'cudaEventQuery' WHEN 3 THEN 'cudaEventRecord' WHEN 4 THEN 'hipEventCreate' WHEN 5 THEN 'cudaGraphLaunch' WHEN 6 THEN 'cudaLaunchKernel' WHEN 7 THEN 'hipMemcpyAsync' WHEN 8 THEN 'StreamBeginCapture' WHEN 9 THEN 'other_call' WHEN 10 THEN 'aclmdlRIExecuteAsync' WHEN 11 THEN 'InplaceCopy' END"


@query("PRJ-04", f"""WITH c AS (SELECT o_orderkey AS call_id, lower(coalesce({_NAME}, '')) AS n FROM orders) SELECT call_id,
 CASE WHEN n LIKE 'acl%' OR n LIKE 'cuda%' OR n LIKE 'hip%' THEN 'public' ELSE 'provider_internal_or_unknown' END AS api_layer,
 CASE WHEN contains(n, 'wait') THEN 'wait' WHEN contains(n, 'synchronize') THEN 'synchronize' WHEN contains(n, 'query') THEN 'query' WHEN contains(n, 'eventrecord') OR contains(n, 'recordevent') THEN 'event_record'
 WHEN contains(n, 'eventcreate') OR contains(n, 'createevent') OR contains(n, 'eventdestroy') OR contains(n, 'destroyevent') THEN 'event_lifecycle' WHEN contains(n, 'graphlaunch') OR contains(n, 'aclmdlriexecuteasync') THEN 'graph_launch'
 WHEN contains(n, 'launch') THEN 'launch' WHEN contains(n, 'memcpy') OR contains(n, 'memset') OR contains(n, 'inplacecopy') THEN 'memory' WHEN contains(n, 'capture') OR contains(n, 'graph') THEN 'graph_control' ELSE 'other' END AS api_family FROM c""")
def api_families(spark, sf):
    name = F.expr(_NAME)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), S.api_layer(name).alias("api_layer"), S.api_family(name).alias("api_family"))


@query("PRJ-05", """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'metal' WHEN regexp_matches(p_brand, '#[0-9]+$') THEN 'brand' || regexp_extract(p_brand, '#([0-9]+)$', 1) ELSE p_name END AS label FROM part""")
def label_lifting(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.lower("p_type").contains("brass"), "metal").when(F.col("p_brand").rlike("#[0-9]+$"), F.concat(F.lit("brand"), F.regexp_extract("p_brand", "#([0-9]+)$", 1))).otherwise(F.col("p_name")).alias("label"))


@query("PRJ-07", f"SELECT event_id, symbol FROM {EV} WHERE symbol NOT IN ('view', 'error')")
def skip_list(spark, sf):
    return trace_event(spark, sf).where(~F.col("symbol").isin("view", "error")).select("event_id", "symbol")


@query("PRJ-08", f"""SELECT e.event_id FROM {EV} e WHERE e.symbol <> '{COMMUNICATION}' AND NOT EXISTS (SELECT 1 FROM {_COMM} c WHERE c.device_id = e.device_id AND c.stream_id = e.stream_id AND c.start_ns <= e.end_ns AND c.end_ns >= e.start_ns)""")
def uncovered(spark, sf):
    e = trace_event(spark, sf)
    other, comm = e.where(F.col("symbol") != COMMUNICATION), e.where(F.col("symbol") == COMMUNICATION)
    covered = I.overlap_join(other, comm.select("device_id", "stream_id", "start_ns", "end_ns"), ["device_id", "stream_id"], closed=True).select("event_id").distinct()
    return other.join(covered, "event_id", "left_anti").select("event_id")


@query("PRJ-09", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def membership(spark, sf):
    members = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(members, "o_orderkey", "left_semi").select("o_orderkey")


_W0, _W1 = 1704326400000000000, 1704412800000000000


@query("PRJ-10", f"SELECT event_id, device_id, start_ns, end_ns FROM {EV} WHERE start_ns < {_W1} AND end_ns > {_W0}")
def device_window(spark, sf):
    return trace_event(spark, sf).where((F.col("start_ns") < _W1) & (F.col("end_ns") > _W0)).select("event_id", "device_id", "start_ns", "end_ns")


@query("PRJ-11", f"SELECT event_id FROM {EV} WHERE (NULL IS NULL OR device_id = NULL) AND (2 IS NULL OR stream_id = 2)")
def optional_parameters(spark, sf):
    trace_event(spark, sf).createOrReplaceTempView("lq_trace_event")
    return spark.sql("SELECT event_id FROM lq_trace_event WHERE (:device IS NULL OR device_id = :device) AND (:stream IS NULL OR stream_id = :stream)", args={"device": None, "stream": 2})


@query("PRJ-12", f"SELECT call_id FROM {RUNTIME_CALL} WHERE (process_id = 0 AND api_name = 'api1-URGENT') OR (process_id = 1 AND api_name IN ('api2-HIGH', 'api5-LOW'))")
def synchronisation_filter(spark, sf):
    p, n = F.col("process_id"), F.col("api_name")
    return runtime_call(spark, sf).where(((p == 0) & (n == "api1-URGENT")) | ((p == 1) & n.isin("api2-HIGH", "api5-LOW"))).select("call_id")


@query("PRJ-13", f"""SELECT e.event_id, e.symbol <> '{WAIT}' AND NOT EXISTS (SELECT 1 FROM {_COMM} c WHERE c.device_id = e.device_id AND c.stream_id = e.stream_id AND c.event_id <> e.event_id AND c.start_ns <= e.start_ns AND c.end_ns >= e.end_ns) AS eligible FROM {EV} e""")
def cost_mask(spark, sf):
    e = trace_event(spark, sf)
    comm = e.where(F.col("symbol") == COMMUNICATION).select("device_id", "stream_id", "event_id", "start_ns", "end_ns")
    inner = e.select("device_id", "stream_id", F.col("event_id"), "start_ns", "end_ns")
    inside = I.containment_join(comm, inner, ["device_id", "stream_id"]).where("event_id <> r_event_id").select(F.col("r_event_id").alias("event_id")).distinct().withColumn("hit", F.lit(True))
    return e.join(inside, "event_id", "left").select("event_id", ((F.col("symbol") != WAIT) & F.col("hit").isNull()).alias("eligible"))


@query("PRJ-14")
def privacy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.public_text(F.col("text")).alias("public"))


@query("PRJ-15", "SELECT n_name, regexp_matches(n_name, '^[A-Za-z0-9_.:-]{1,128}$') AS label_ok, regexp_matches(md5(n_name), '^[0-9a-f]{32}$') AS hex_ok FROM nation")
def label_grammar(spark, sf):
    return table(spark, sf, "nation").select("n_name", S.label_ok(F.col("n_name")).alias("label_ok"), S.hex_id_ok(F.md5("n_name"), 32).alias("hex_ok"))


@query("PRJ-16", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N'")
def self_coverage(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber")


@query("JOIN-01", "SELECT o_orderkey, l_linenumber, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_custkey % 4 = l_suppkey % 4")
def composite_join(spark, sf):
    o = table(spark, sf, "orders").withColumns({"k": F.col("o_orderkey"), "g": F.col("o_custkey") % 4})
    x = table(spark, sf, "lineitem").withColumns({"k": F.col("l_orderkey"), "g": F.col("l_suppkey") % 4})
    return o.join(x, ["k", "g"]).select("o_orderkey", "l_linenumber", "o_orderstatus")


@query("JOIN-02", f"""SELECT o.o_orderkey, c.c_name, w.n FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey
 LEFT JOIN (SELECT correlation_id, count(*) AS n FROM {DEVICE_WORK} WHERE device_id = 1 GROUP BY 1) w ON w.correlation_id = o.o_orderkey""")
def left_joins(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    w = device_work(spark, sf).where("device_id = 1").groupBy(F.col("correlation_id").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left").join(w, "o_orderkey", "left").select("o_orderkey", "c_name", "n")


_CORR = f"""WITH c AS (SELECT * FROM {RUNTIME_CALL}), w AS (SELECT * FROM {DEVICE_WORK}),
 nc AS (SELECT correlation_id AS k, count(*) AS nc, min(call_id) AS only_call FROM c WHERE correlation_id IS NOT NULL GROUP BY 1),
 nw AS (SELECT correlation_id AS k, count(*) AS nw FROM w WHERE correlation_id IS NOT NULL GROUP BY 1)
SELECT call_id, CAST(NULL AS BIGINT) AS work_id, CASE WHEN correlation_id IS NULL OR nw IS NULL THEN 'one_to_none' ELSE 'many_to_many' END AS cardinality,
 CASE WHEN correlation_id IS NULL THEN 'missing_runtime_identifier' WHEN nw IS NULL THEN 'unmatched_call' ELSE 'rejected_reused_correlation_id' END AS support_state
 FROM c LEFT JOIN nc ON nc.k = correlation_id LEFT JOIN nw ON nw.k = correlation_id WHERE correlation_id IS NULL OR nw IS NULL OR nc > 1
UNION ALL SELECT CASE WHEN nc = 1 THEN only_call END, work_id, CASE WHEN correlation_id IS NULL OR nc IS NULL THEN 'none_to_one' WHEN nc > 1 THEN 'many_to_many' WHEN nw = 1 THEN 'one_to_one' ELSE 'one_to_many' END,
 CASE WHEN correlation_id IS NULL THEN 'missing_device_identifier' WHEN nc IS NULL THEN 'unmatched_work' WHEN nc > 1 THEN 'rejected_reused_correlation_id' WHEN nw = 1 THEN 'supported_exact' ELSE 'supported_deterministic' END
 FROM w LEFT JOIN nc ON nc.k = correlation_id LEFT JOIN nw ON nw.k = correlation_id"""


@query("JOIN-03", _CORR)
def correlation(spark, sf):
    return R.correlated(runtime_call(spark, sf), device_work(spark, sf))


@query("CTX-01", f"SELECT support_state, cardinality, count(*) AS n FROM ({_CORR}) GROUP BY 1, 2")
def correlation_states(spark, sf):
    return R.correlated(runtime_call(spark, sf), device_work(spark, sf)).groupBy("support_state", "cardinality").agg(F.count("*").alias("n"))


@query("JOIN-04", f"""WITH m AS (SELECT w.work_id, c.call_id FROM (SELECT *, device_id AS g FROM {DEVICE_WORK}) w
 LEFT JOIN (SELECT *, process_id AS g FROM {RUNTIME_CALL}) c ON c.g = w.g AND w.start_ns >= c.start_ns AND w.end_ns <= c.end_ns)
 SELECT work_id, CASE WHEN count(call_id) = 1 THEN min(call_id) END AS call_id, CASE WHEN count(call_id) = 1 THEN 'supported_deterministic' WHEN count(call_id) > 1 THEN 'ambiguous_runtime_scope' ELSE 'unmatched_work' END AS support_state
 FROM m GROUP BY work_id""")
def reused_ids(spark, sf):
    return R.contained_once(runtime_call(spark, sf).withColumnRenamed("process_id", "g"), device_work(spark, sf).withColumnRenamed("device_id", "g"), "g")


@query("JOIN-05", f"""SELECT e.event_id, c.event_id AS r_event_id, CASE WHEN c.start_ns >= e.start_ns AND c.end_ns <= e.end_ns THEN 'contained' ELSE 'boundary_overlap' END AS relation,
 round((least(c.end_ns, e.end_ns) - greatest(c.start_ns, e.start_ns)) / 1000.0, 3) AS overlap_us,
 row_number() OVER (PARTITION BY e.event_id ORDER BY c.start_ns, c.end_ns, c.event_id) - 1 AS observed_order
 FROM {EV} e JOIN {_COMM} c ON c.device_id = e.device_id AND c.start_ns < e.end_ns AND e.start_ns < c.end_ns WHERE e.symbol = '{WAIT}'""")
def overlaps(spark, sf):
    e = trace_event(spark, sf)
    side = lambda symbol: e.where(F.col("symbol") == symbol).select("device_id", "event_id", "start_ns", "end_ns")
    met = I.ordered_overlaps(side(WAIT), side(COMMUNICATION), ["device_id"], "event_id")
    inside = (F.col("r_start_ns") >= F.col("start_ns")) & (F.col("r_end_ns") <= F.col("end_ns"))
    return met.select("event_id", "r_event_id", F.when(inside, "contained").otherwise("boundary_overlap").alias("relation"), S.micros(S.null_least("r_end_ns", "end_ns") - S.null_greatest("r_start_ns", "start_ns")).alias("overlap_us"), "observed_order")


@query("JOIN-07", "SELECT n_nationkey, s.pos, n_regionkey FROM nation JOIN (SELECT unnest(range(0, 40)) AS pos) s ON s.pos >= n_nationkey AND s.pos < n_nationkey + n_regionkey")
def position_interval(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey > 0")
    return n.select("n_nationkey", F.explode(F.sequence(F.col("n_nationkey").cast("long"), F.col("n_nationkey").cast("long") + F.col("n_regionkey") - 1)).alias("pos"), "n_regionkey")


@query("JOIN-08", f"""WITH r AS (SELECT event_id AS region_id, device_id, start_ns, end_ns FROM {_COMM}) SELECT e.event_id, min(r.region_id) AS region_id, count(r.region_id) AS regions FROM {EV} e LEFT JOIN r ON r.device_id = e.device_id AND e.start_ns BETWEEN r.start_ns AND r.end_ns GROUP BY e.event_id""")
def between_join(spark, sf):
    e = trace_event(spark, sf)
    regions = e.where(F.col("symbol") == COMMUNICATION).select("device_id", F.col("event_id").alias("region_id"), "start_ns", "end_ns")
    points = e.select("device_id", "event_id", "start_ns", F.col("start_ns").alias("end_ns"))
    hit = I.containment_join(regions, points, ["device_id"]).groupBy("event_id").agg(F.min("region_id").alias("region_id"), F.count("*").alias("regions"))
    return e.select("event_id").join(hit, "event_id", "left").select("event_id", "region_id", F.coalesce("regions", F.lit(0)).alias("regions"))


_FOLLOW = f"""SELECT e.event_id, (SELECT min(a.event_id) FROM {_COMM} a WHERE a.device_id = e.device_id AND a.start_ns = (SELECT min(b.start_ns) FROM {_COMM} b WHERE b.device_id = e.device_id AND b.start_ns >= e.end_ns)) AS following FROM {EV} e WHERE e.symbol = '{WAIT}'"""


def _following(spark, sf):
    e = trace_event(spark, sf)
    return I.following(e.where(F.col("symbol") == WAIT), e.where(F.col("symbol") == COMMUNICATION), ["device_id"], "end_ns", "start_ns", "event_id")


@query("JOIN-09", _FOLLOW)
def as_of_forward(spark, sf):
    return _following(spark, sf).select("event_id", "following")


@query("CST-05", f"""SELECT following AS anchor_id, count(*) AS aux_events, CAST(sum(end_ns - start_ns) AS BIGINT) AS aux_ns FROM (SELECT e.*, f.following FROM {EV} e JOIN ({_FOLLOW}) f USING (event_id)) WHERE following IS NOT NULL GROUP BY 1""")
def aux_attribution(spark, sf):
    return _following(spark, sf).where("following is not null").groupBy(F.col("following").alias("anchor_id")).agg(F.count("*").alias("aux_events"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("aux_ns"))


@query("AGG-20", f"""WITH l AS (SELECT e.event_id, e.start_ns, e.end_ns, f.following FROM {EV} e JOIN ({_FOLLOW}) f USING (event_id) WHERE f.following IS NOT NULL)
 SELECT following AS anchor_id, event_id, row_number() OVER (PARTITION BY following ORDER BY start_ns, event_id) AS aux_order FROM l""")
def aux_slots(spark, sf):
    w = Window.partitionBy("following").orderBy("start_ns", "event_id")
    return _following(spark, sf).where("following is not null").select(F.col("following").alias("anchor_id"), "event_id", F.row_number().over(w).cast("long").alias("aux_order"))


_NEAR = f"""WITH m AS (SELECT w.work_id, c.call_id, c.start_ns, abs(c.start_ns - w.start_ns) AS d FROM {DEVICE_WORK} w JOIN {RUNTIME_CALL} c ON c.correlation_id = w.correlation_id)
 SELECT work_id, nearest, delta_ns FROM (SELECT work_id, call_id AS nearest, d AS delta_ns, row_number() OVER (PARTITION BY work_id ORDER BY d, start_ns, call_id) AS k FROM m) WHERE k = 1"""


@query("JOIN-12", _NEAR)
def nearest_call(spark, sf):
    return I.nearest(device_work(spark, sf), runtime_call(spark, sf), ["correlation_id"], "work_id", "start_ns", "call_id", "start_ns")


@query("JOIN-10")
def claimed_nearest(spark, sf):
    e = trace_event(spark, sf)
    side = lambda symbol, name: e.where(F.col("symbol") == symbol).select("device_id", "stream_id", F.col("event_id").alias(name), "start_ns", "end_ns")
    return R.claimed(side(COMMUNICATION, "launch"), side(WAIT, "wait"), ["device_id", "stream_id"], "launch", "wait")


@query("JOIN-11", f"""WITH a AS (SELECT device_id, stream_id, event_id, row_number() OVER (PARTITION BY device_id, stream_id, day ORDER BY start_ns, event_id) AS k, count(*) OVER (PARTITION BY device_id, stream_id, day) AS n, day FROM (SELECT *, start_ns // 86400000000000 AS day FROM {_COMM})),
 b AS (SELECT device_id, stream_id, event_id, row_number() OVER (PARTITION BY device_id, stream_id, day ORDER BY start_ns, event_id) AS k, count(*) OVER (PARTITION BY device_id, stream_id, day) AS n, day FROM (SELECT *, start_ns // 86400000000000 AS day FROM {EV} WHERE symbol = '{WAIT}'))
 SELECT a.device_id, a.stream_id, a.day, a.k AS ordinal, a.event_id AS left_id, b.event_id AS right_id FROM a JOIN b USING (device_id, stream_id, day, k, n)""")
def ordinal_fallback(spark, sf):
    e = trace_event(spark, sf).withColumn("day", F.expr("start_ns div 86400000000000"))
    out = R.ordinal_pairs(e.where(F.col("symbol") == COMMUNICATION), e.where(F.col("symbol") == WAIT), ["device_id", "stream_id", "day"], "event_id", ["start_ns", "event_id"], "event_id", ["start_ns", "event_id"])
    return out.withColumn("ordinal", F.col("ordinal").cast("long"))


@query("JOIN-13", f"SELECT event_id, lag(event_id) OVER w AS left_id, start_ns - lag(end_ns) OVER w AS gap_ns FROM {EV} WINDOW w AS (PARTITION BY device_id ORDER BY start_ns, end_ns, event_id)")
def adjacent(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "end_ns", "event_id")
    return trace_event(spark, sf).select("event_id", F.lag("event_id").over(w).alias("left_id"), (F.col("start_ns") - F.lag("end_ns").over(w)).alias("gap_ns"))


@query("JOIN-14", f"""WITH q AS (SELECT call_id, correlation_id, (call_id * 4294967296 + 7) >> 32 AS process, count(*) OVER (PARTITION BY correlation_id) AS n FROM {RUNTIME_CALL} WHERE correlation_id IS NOT NULL)
 SELECT a.call_id AS enqueue_id, b.call_id AS dequeue_id, a.process FROM q a JOIN q b ON a.correlation_id = b.correlation_id AND a.call_id % 2 = 0 AND b.call_id % 2 = 1 WHERE a.n = 2""")
def queue_pairs(spark, sf):
    q = runtime_call(spark, sf).where("correlation_id is not null").select("call_id", "correlation_id", F.shiftright(F.col("call_id") * 4294967296 + 7, 32).alias("process"), F.count("*").over(Window.partitionBy("correlation_id")).alias("n")).where("n = 2")
    b = q.where("call_id % 2 = 1").select("correlation_id", F.col("call_id").alias("dequeue_id"))
    return q.where("call_id % 2 = 0").join(b, "correlation_id").select(F.col("call_id").alias("enqueue_id"), "dequeue_id", "process")


@query("JOIN-15", "SELECT o_orderkey, l_linenumber, n_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_quantity > 40")
def forced_order(spark, sf):
    x = table(spark, sf, "lineitem").where("l_quantity > 40").withColumnRenamed("l_orderkey", "o_orderkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf, "orders").join(x, "o_orderkey").join(c, "o_custkey").join(table(spark, sf, "nation"), "n_nationkey").select("o_orderkey", "l_linenumber", "n_name")


@query("JOIN-16", "SELECT a.r_name AS source, b.r_name AS target FROM region a CROSS JOIN region b WHERE a.r_regionkey <> b.r_regionkey")
def tiny_cross(spark, sf):
    r = table(spark, sf, "region")
    a, b = r.select(F.col("r_name").alias("source"), F.col("r_regionkey").alias("x")), r.select(F.col("r_name").alias("target"), F.col("r_regionkey").alias("y"))
    return a.crossJoin(b).where("x <> y").select("source", "target")


@query("JOIN-17", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS supported FROM customer")
def semi(spark, sf):
    has = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return table(spark, sf, "customer").join(has, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("supported"))


@query("JOIN-18", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("JOIN-19", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, (SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey) AS quantity, (SELECT max(l_discount) FROM lineitem WHERE l_orderkey = o_orderkey) AS discount FROM orders")
def scalar_subqueries(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.max("l_discount").alias("discount"))
    return table(spark, sf, "orders").join(x, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), "quantity", "discount")


@query("JOIN-20", "SELECT o_orderkey, (row_number() OVER w) - 1 AS observed_order, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def previous_row(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", (F.row_number().over(w).cast("long") - 1).alias("observed_order"), F.lag("o_orderkey").over(w).alias("previous"))


@query("JOIN-21", "SELECT event_id, k.key AS name, CAST(k.value AS VARCHAR) AS value FROM events, json_each(props) k")
def unnest_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


@query("JOIN-22", f"""WITH g AS (SELECT device_id, stream_id, CAST(start_ns // 3600000000000 AS BIGINT) AS hour, count(*) FILTER (symbol = '{WAIT}') AS generic_n, count(*) FILTER (symbol = '{COMMUNICATION}') AS concrete_n FROM {EV} GROUP BY 1, 2, 3)
 SELECT device_id, stream_id, hour, generic_n, concrete_n, CASE WHEN generic_n = 1 AND concrete_n = 1 THEN 'matched' WHEN generic_n > 0 AND concrete_n > 0 THEN 'ambiguous' ELSE 'independent' END AS status FROM g""")
def identity_match(spark, sf):
    e = trace_event(spark, sf).withColumn("hour", F.expr("start_ns div 3600000000000"))
    g = e.groupBy("device_id", "stream_id", "hour").agg(F.count_if(F.col("symbol") == WAIT).alias("generic_n"), F.count_if(F.col("symbol") == COMMUNICATION).alias("concrete_n"))
    return g.withColumn("status", F.expr("CASE WHEN generic_n = 1 AND concrete_n = 1 THEN 'matched' WHEN generic_n > 0 AND concrete_n > 0 THEN 'ambiguous' ELSE 'independent' END"))


@query("JOIN-23", f"""WITH m AS (SELECT e.event_id AS outer_id, c.event_id AS inner_id FROM {EV} e JOIN {_COMM} c ON c.device_id = e.device_id AND c.start_ns >= e.start_ns AND c.end_ns <= e.end_ns AND e.symbol = '{WAIT}'),
 n AS (SELECT *, count(*) OVER (PARTITION BY outer_id) AS a, count(*) OVER (PARTITION BY inner_id) AS b FROM m) SELECT outer_id, inner_id FROM n WHERE a = 1 AND b = 1""")
def unique_containment(spark, sf):
    e = trace_event(spark, sf)
    met = I.containment_join(e.where(F.col("symbol") == WAIT).select("device_id", "event_id", "start_ns", "end_ns"), e.where(F.col("symbol") == COMMUNICATION).select("device_id", "event_id", "start_ns", "end_ns"), ["device_id"])
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return met.withColumns({"a": n("event_id"), "b": n("r_event_id")}).where("a = 1 and b = 1").select(F.col("event_id").alias("outer_id"), F.col("r_event_id").alias("inner_id"))


@query("JOIN-25", "SELECT l_orderkey AS o_orderkey, o_orderpriority, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1")
def using_join(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), on=["o_orderkey"]).where("l_linenumber = 1").select("o_orderkey", "o_orderpriority", "l_shipdate")


@query("JOIN-26", f"""SELECT g.event_id AS graph_id, count(*) AS events, count(*) FILTER (e.stream_id = g.stream_id) AS same_stream, count(*) FILTER (e.stream_id <> g.stream_id) AS other_stream
 FROM {_COMM} g JOIN {EV} e ON e.device_id = g.device_id AND e.start_ns < g.end_ns AND g.start_ns < e.end_ns AND e.symbol <> '{COMMUNICATION}' GROUP BY 1""")
def graph_overlap(spark, sf):
    e = trace_event(spark, sf).select("device_id", "stream_id", "event_id", "start_ns", "end_ns", "symbol")
    met = I.overlap_join(e.where(F.col("symbol") == COMMUNICATION), e.where(F.col("symbol") != COMMUNICATION), ["device_id"])
    return met.groupBy(F.col("event_id").alias("graph_id")).agg(F.count("*").alias("events"), F.count_if(F.col("stream_id") == F.col("r_stream_id")).alias("same_stream"), F.count_if(F.col("stream_id") != F.col("r_stream_id")).alias("other_stream"))


@query("JOIN-06", f"""WITH b AS (SELECT event_id AS bubble_id, device_id, prior AS start_ns, start_ns AS end_ns FROM (SELECT *, max(end_ns) OVER (PARTITION BY device_id, stream_id ORDER BY start_ns, end_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM {EV}) WHERE start_ns > prior)
 SELECT b.bubble_id, count(*) AS calls, CAST(sum(least(c.end_ns, b.end_ns) - greatest(c.start_ns, b.start_ns)) AS BIGINT) AS overlap_ns FROM b JOIN {_COMM} c ON c.device_id = b.device_id AND c.start_ns < b.end_ns AND b.start_ns < c.end_ns GROUP BY 1""")
def bubble_calls(spark, sf):
    e = trace_event(spark, sf)
    gap = I.gaps(e, ["device_id", "stream_id"], "event_id").select("device_id", F.col("event_id").alias("bubble_id"), F.col("gap_start").alias("start_ns"), F.col("gap_end").alias("end_ns"))
    met = I.overlap_join(gap, e.where(F.col("symbol") == COMMUNICATION).select("device_id", "start_ns", "end_ns"), ["device_id"])
    return met.groupBy("bubble_id").agg(F.count("*").alias("calls"), F.sum(F.least("r_end_ns", "end_ns") - F.greatest("r_start_ns", "start_ns")).alias("overlap_ns"))


_OWN = f"""WITH e AS (SELECT device_id, event_id, start_ns, end_ns, CASE WHEN symbol = '{COMMUNICATION}' THEN 0 ELSE 1 END AS p FROM {EV} WHERE end_ns > start_ns),
 t AS (SELECT DISTINCT device_id, start_ns AS a FROM e UNION SELECT device_id, end_ns FROM e), s AS (SELECT device_id, a, lead(a) OVER (PARTITION BY device_id ORDER BY a) AS b FROM t),
 o AS (SELECT s.device_id, s.a, s.b, arg_min(e.event_id, e.p * 1000000000 + e.event_id) AS owner FROM s JOIN e ON e.device_id = s.device_id AND e.start_ns <= s.a AND e.end_ns >= s.b WHERE s.b IS NOT NULL GROUP BY 1, 2, 3)
 SELECT device_id, owner AS event_id, CAST(sum(b - a) AS BIGINT) AS owned_ns FROM o GROUP BY 1, 2"""


def _owned(spark, sf):
    return I.ownership(trace_event(spark, sf), ["device_id"], "event_id", F.when(F.col("symbol") == COMMUNICATION, 1).otherwise(0))


@query("CST-01", _OWN)
def ownership(spark, sf):
    return _owned(spark, sf)


@query("STC-09", _BUSY_SQL.format(src=f"SELECT * FROM {EV}", keys="device_id").replace("SELECT device_id, count(*)", "SELECT device_id, TRUE AS conserved, count(*)"))
def conservation(spark, sf):
    owned = _owned(spark, sf).groupBy("device_id").agg(F.sum("owned_ns").alias("owned"))
    busy = I.busy(trace_event(spark, sf), ["device_id"])
    return busy.join(owned, "device_id").select("device_id", (F.col("owned") == F.col("union_ns")).alias("conserved"), "intervals", "union_ns", "sum_ns", "envelope_ns")


_GAP = f"""SELECT device_id, stream_id, event_id, prior AS gap_start, start_ns AS gap_end FROM (SELECT *, max(end_ns) OVER (PARTITION BY device_id, stream_id ORDER BY start_ns, end_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM {EV}) WHERE start_ns > prior"""


@query("CST-02", _GAP)
def preludes(spark, sf):
    return I.gaps(trace_event(spark, sf), ["device_id", "stream_id"], "event_id")


@query("WIN-09", f"SELECT device_id, stream_id, count(*) AS gaps, CAST(sum(gap_end - gap_start) AS BIGINT) AS silent_ns FROM ({_GAP}) GROUP BY 1, 2")
def silence(spark, sf):
    return I.gaps(trace_event(spark, sf), ["device_id", "stream_id"], "event_id").groupBy("device_id", "stream_id").agg(F.count("*").alias("gaps"), F.sum(F.col("gap_end") - F.col("gap_start")).alias("silent_ns"))


@query("CST-03", f"""WITH g AS ({_GAP}), x AS (SELECT g.event_id, e.symbol, greatest(g.gap_start, e.start_ns) AS a, least(g.gap_end, e.end_ns) AS b FROM g JOIN {EV} e ON e.device_id = g.device_id AND e.start_ns < g.gap_end AND g.gap_start < e.end_ns),
 u AS (SELECT event_id, k, CAST(sum(greatest(0, b - greatest(a, coalesce(prior, a)))) AS BIGINT) AS ns FROM (SELECT event_id, k, a, b, max(b) OVER (PARTITION BY event_id, k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM
  (SELECT event_id, 1 AS k, a, b FROM x WHERE symbol = '{COMMUNICATION}' UNION ALL SELECT event_id, 2, a, b FROM x WHERE symbol <> '{WAIT}')) GROUP BY 1, 2),
 n AS (SELECT event_id, count(*) AS aux_events, CAST(sum(b - a) AS BIGINT) AS aux_ns FROM x GROUP BY 1)
 SELECT g.device_id, g.event_id, gap_end - gap_start AS gap_ns, coalesce(c.ns, 0) AS comm_ns, coalesce(d.ns, 0) - coalesce(c.ns, 0) AS exec_ns, gap_end - gap_start - coalesce(d.ns, 0) AS idle_ns, coalesce(aux_events, 0) AS aux_events, coalesce(aux_ns, 0) AS aux_ns
 FROM g LEFT JOIN u c ON c.event_id = g.event_id AND c.k = 1 LEFT JOIN u d ON d.event_id = g.event_id AND d.k = 2 LEFT JOIN n ON n.event_id = g.event_id""")
def gap_split(spark, sf):
    e = trace_event(spark, sf)
    gap = I.gaps(e, ["device_id", "stream_id"], "event_id").drop("stream_id")
    comm = F.col("symbol") == COMMUNICATION
    return I.gap_costs(gap, e, ["device_id"], "event_id", comm, ~comm & (F.col("symbol") != WAIT))


@query("CST-04", "SELECT o_orderkey, contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus)), 'low') AS is_wait FROM orders")
def wait_predicate(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).contains("low").alias("is_wait"))


@query("CST-07", f"""WITH g AS ({_GAP}) SELECT g.event_id AS bubble_id, e.symbol, round((gap_end - gap_start) / 1000.0, 3) AS bubble_us FROM g JOIN {EV} e USING (event_id) WHERE e.symbol <> '{WAIT}' AND round((gap_end - gap_start) / 1000.0, 3) > 0""")
def bubbles(spark, sf):
    e = trace_event(spark, sf)
    gap = I.gaps(e, ["device_id", "stream_id"], "event_id").withColumn("bubble_us", S.micros(F.col("gap_end") - F.col("gap_start")))
    return gap.join(e.select("event_id", "symbol"), "event_id").where((F.col("symbol") != WAIT) & (F.col("bubble_us") > 0)).select(F.col("event_id").alias("bubble_id"), "symbol", "bubble_us")


# -- aggregates


@query("AGG-01", f"""SELECT device_id, stream_id, symbol, count(*) AS anchor_count, min(start_ns) AS start_ns, max(end_ns) AS end_ns, min(event_id) AS first_event, max(event_id) AS last_event, round(CAST(sum(end_ns - start_ns) AS BIGINT) / 1000.0, 3) AS total_us FROM {EV} GROUP BY 1, 2, 3""")
def occurrence_rollup(spark, sf):
    return trace_event(spark, sf).groupBy("device_id", "stream_id", "symbol").agg(F.count("*").alias("anchor_count"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), S.micros(F.sum(F.col("end_ns") - F.col("start_ns"))).alias("total_us"))


@query("AGG-02", """SELECT c_custkey, coalesce(a.n, 0) AS orders, coalesce(b.q, 0) AS quantity FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) b ON b.o_custkey = c_custkey""")
def node_cost(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    a, b = o.groupBy("c_custkey").agg(F.count("*").alias("n")), o.join(x, "o_orderkey").groupBy("c_custkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return table(spark, sf, "customer").join(a, "c_custkey", "left").join(b, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("q", F.lit(0)).alias("quantity"))


@query("AGG-03", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS open_n, CAST(sum(CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END) AS BIGINT) AS large FROM lineitem GROUP BY 1")
def conditional(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open_n"), F.sum(F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0)).cast("long").alias("large"))


@query("AGG-04", """WITH p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT o_custkey, o_orderpriority, count(*) AS k FROM orders GROUP BY 1, 2)
 SELECT q.o_custkey, q.o_orderpriority, round(q.k * 1.0 / p.n, 6) AS presence FROM q JOIN p USING (o_custkey)""")
def ratio(spark, sf):
    o = table(spark, sf, "orders")
    p = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("k")).join(p, "o_custkey").select("o_custkey", "o_orderpriority", F.round(F.col("k") * 1.0 / F.col("n"), 6).alias("presence"))


@query("AGG-05", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1")
def distinct_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds"))


@query("AGG-06", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || '/' || l_linestatus) = 1")
def having_single(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(F.struct("l_returnflag", "l_linestatus")).alias("n")).where("n = 1").select("l_orderkey")


@query("AGG-07", f"SELECT symbol, stream_id, count(*) AS n, CAST(sum(end_ns - start_ns) AS BIGINT) AS total_ns, min(end_ns - start_ns) AS min_ns, max(end_ns - start_ns) AS max_ns, round(CAST(sum(end_ns - start_ns) AS BIGINT) / 1000.0 / count(*), 3) AS avg_us FROM {EV} GROUP BY 1, 2")
def variant_cost(spark, sf):
    d = F.col("end_ns") - F.col("start_ns")
    return trace_event(spark, sf).groupBy("symbol", "stream_id").agg(F.count("*").alias("n"), F.sum(d).alias("total_ns"), F.min(d).alias("min_ns"), F.max(d).alias("max_ns"), F.round(F.sum(d) / 1000.0 / F.count("*"), 3).alias("avg_us"))


@query("AGG-08", """WITH p AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS parents, min(n) AS least, max(n) AS most, CASE WHEN min(n) = max(n) THEN 'uniform' ELSE 'nonuniform' END AS shape FROM p GROUP BY 1""")
def two_level(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return p.groupBy("l_returnflag").agg(F.count("*").alias("parents"), F.min("n").alias("least"), F.max("n").alias("most"), F.when(F.min("n") == F.max("n"), "uniform").otherwise("nonuniform").alias("shape"))


@query("AGG-09", "SELECT l_orderkey, CASE WHEN count(*) = 1 THEN min(l_suppkey) END AS only_supplier FROM lineitem GROUP BY 1")
def unique_pick(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.when(F.count("*") == 1, F.min("l_suppkey")).alias("only_supplier"))


_LISTS = f"(SELECT device_id, stream_id, count(*) AS n, list(end_ns - start_ns ORDER BY end_ns - start_ns) AS v FROM {EV} GROUP BY 1, 2)"


@query("AGG-12", f"SELECT device_id, stream_id, v[((n - 1) * 1 + 2) // 4 + 1] AS q1_ns, CAST(floor((v[(n + 1) // 2] + v[n // 2 + 1]) // 2) AS BIGINT) AS median_ns, v[((n - 1) * 3 + 2) // 4 + 1] AS q3_ns FROM {_LISTS}")
def quartiles(spark, sf):
    v = trace_event(spark, sf).groupBy("device_id", "stream_id").agg(F.sort_array(F.collect_list(F.col("end_ns") - F.col("start_ns"))).alias("v"))
    return v.select("device_id", "stream_id", S.quartile(F.col("v"), 1).alias("q1_ns"), S.middle(F.col("v")).alias("median_ns"), S.quartile(F.col("v"), 3).alias("q3_ns"))


@query("AGG-13", "SELECT scope, l_returnflag, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM (SELECT 'all' AS scope, * FROM lineitem UNION ALL SELECT 'exact', * FROM lineitem WHERE l_discount = 0) GROUP BY 1, 2")
def two_scopes(spark, sf):
    x = table(spark, sf, "lineitem")
    both = x.withColumn("scope", F.lit("all")).unionByName(x.where("l_discount = 0").withColumn("scope", F.lit("exact")))
    return both.groupBy("scope", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("AGG-14", f"""SELECT device_id, stream_id, symbol, count(*) AS n, min(end_ns - start_ns) = max(end_ns - start_ns) AS consistent, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS contributors FROM {EV} GROUP BY 1, 2, 3""")
def aligned(spark, sf):
    d = F.col("end_ns") - F.col("start_ns")
    return trace_event(spark, sf).groupBy("device_id", "stream_id", "symbol").agg(F.count("*").alias("n"), (F.min(d) == F.max(d)).alias("consistent"), F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("contributors"))


@query("AGG-15", f"SELECT device_id, symbol, count(*) AS n, min(event_id) AS first_event FROM {EV} GROUP BY 1, 2 HAVING count(*) > 1")
def partial_final(spark, sf):
    return trace_event(spark, sf).groupBy("device_id", "symbol").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).where("n > 1")


@query("AGG-16", "SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1")
def unique_count(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").dropDuplicates().groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("AGG-17", f"SELECT symbol, count(*) AS n, CAST(sum(end_ns - start_ns) AS BIGINT) AS total_ns FROM {EV} GROUP BY 1")
def cost_summary(spark, sf):
    return trace_event(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("total_ns"))


@query("AGG-18", f"""SELECT stream_id, CAST(sum(end_ns - start_ns) AS BIGINT) AS total_ns, CAST(coalesce(sum(end_ns - start_ns) FILTER (symbol = '{COMMUNICATION}'), 0) AS BIGINT) AS comm_ns, CAST(coalesce(sum(end_ns - start_ns) FILTER (symbol = '{WAIT}'), 0) AS BIGINT) AS wait_ns FROM {EV} GROUP BY 1""")
def breakdown(spark, sf):
    d = F.col("end_ns") - F.col("start_ns")
    part = lambda s: F.coalesce(F.sum(F.when(F.col("symbol") == s, d)), F.lit(0))
    return trace_event(spark, sf).groupBy("stream_id").agg(F.sum(d).alias("total_ns"), part(COMMUNICATION).alias("comm_ns"), part(WAIT).alias("wait_ns"))


@query("AGG-21", "SELECT p_type, p_brand IN ('Brand#11', 'Brand#12') AS marked, count(*) AS parts, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1, 2")
def audit(spark, sf):
    return table(spark, sf, "part").groupBy("p_type", F.col("p_brand").isin("Brand#11", "Brand#12").alias("marked")).agg(F.count("*").alias("parts"), F.count_distinct("p_size").alias("sizes"))


@query("AGG-23", "SELECT o_orderstatus, count(*) AS n, CAST(round(sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END)) AS BIGINT) AS urgent FROM orders GROUP BY 1")
def role_coverage(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("o_orderpriority").like("1%"), F.col("o_totalprice")).otherwise(0))).cast("long").alias("urgent"))


@query("AGG-24", """SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, min(turn) FILTER (role = 'assistant') AS first_answer, max(turn) FILTER (role = 'assistant') AS last_answer, count(*) FILTER (role = 'system') AS system_turns FROM conversations GROUP BY 1""")
def request_catalog(spark, sf):
    r = F.col("role")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(r == "user").alias("user_turns"), F.min(F.when(r == "assistant", F.col("turn"))).alias("first_answer"), F.max(F.when(r == "assistant", F.col("turn"))).alias("last_answer"), F.count_if(r == "system").alias("system_turns"))


@query("AGG-26", "SELECT l_partkey, count(*) AS suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1")
def device_assignment(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("suppliers"))


@query("AGG-27", "SELECT p_brand, min(p_size) AS least, round(avg(p_size), 6) AS mean, max(p_size) AS most FROM part GROUP BY 1")
def pattern_stats(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_size").alias("least"), F.round(F.avg("p_size"), 6).alias("mean"), F.max("p_size").alias("most"))


@query("AGG-28", f"SELECT device_id, CAST(sum(m) AS BIGINT) AS dropped FROM (SELECT device_id, stream_id, max(event_id) AS m FROM {EV} GROUP BY 1, 2) GROUP BY 1")
def dropped_counters(spark, sf):
    per = trace_event(spark, sf).groupBy("device_id", "stream_id").agg(F.max("event_id").alias("m"))
    return per.groupBy("device_id").agg(F.sum("m").alias("dropped"))


@query("AGG-29", f"""WITH s AS (SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY start_ns, event_id) AS pos, CAST(sum(end_ns - start_ns) OVER (PARTITION BY device_id ORDER BY start_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM {EV})
 SELECT b.device_id, b.pos, b.total - a.total AS span_ns FROM s a JOIN s b ON a.device_id = b.device_id AND b.pos = a.pos + 10""")
def prefix_sums(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "event_id")
    s = trace_event(spark, sf).select("device_id", F.row_number().over(w).cast("long").alias("pos"), F.sum(F.col("end_ns") - F.col("start_ns")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    a = s.select("device_id", (F.col("pos") + 10).alias("pos"), F.col("total").alias("before"))
    return s.join(a, ["device_id", "pos"]).select("device_id", "pos", (F.col("total") - F.col("before")).alias("span_ns"))


# -- windows, sorts, sets


@query("WIN-01", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem")
def row_number0(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w).cast("long") - 1).alias("k"))


@query("WIN-02", f"SELECT event_id, row_number() OVER (PARTITION BY device_id, stream_id, symbol ORDER BY start_ns, end_ns, event_id) - 1 AS k FROM {EV}")
def row_number3(spark, sf):
    w = Window.partitionBy("device_id", "stream_id", "symbol").orderBy("start_ns", "end_ns", "event_id")
    return trace_event(spark, sf).select("event_id", (F.row_number().over(w).cast("long") - 1).alias("k"))


@query("WIN-04", f"SELECT event_id, row_number() OVER (PARTITION BY device_id ORDER BY start_ns, end_ns, event_id) AS timeline_order FROM {EV}")
def timeline_order(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "end_ns", "event_id")
    return trace_event(spark, sf).select("event_id", F.row_number().over(w).cast("long").alias("timeline_order"))


@query("WIN-05", f"SELECT event_id, coalesce(lead(start_ns) OVER (PARTITION BY device_id ORDER BY start_ns, event_id) < end_ns, FALSE) AS overlaps_next FROM {EV}")
def lead_overlap(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "event_id")
    return trace_event(spark, sf).select("event_id", F.coalesce(F.lead("start_ns").over(w) < F.col("end_ns"), F.lit(False)).alias("overlaps_next"))


@query("WIN-06", f"""SELECT event_id, lead(event_id) OVER w AS next_id, lead(start_ns) OVER w AS next_start, lead(symbol) OVER w AS next_symbol, row_number() OVER w AS k, count(*) OVER (PARTITION BY device_id) AS n FROM {EV} WINDOW w AS (PARTITION BY device_id ORDER BY start_ns, event_id)""")
def lead3(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "event_id")
    return trace_event(spark, sf).select("event_id", F.lead("event_id").over(w).alias("next_id"), F.lead("start_ns").over(w).alias("next_start"), F.lead("symbol").over(w).alias("next_symbol"), F.row_number().over(w).cast("long").alias("k"), F.count("*").over(Window.partitionBy("device_id")).alias("n"))


@query("WIN-07", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) = 1 AS is_only FROM lineitem")
def count_over(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.count("*").over(Window.partitionBy("l_orderkey", "l_suppkey")) == 1).alias("is_only"))


@query("WIN-12", f"SELECT event_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_ns, event_id) AS aux_order FROM {EV} WHERE symbol = '{WAIT}'")
def aux_order(spark, sf):
    w = Window.partitionBy("stream_id").orderBy("start_ns", "event_id")
    return trace_event(spark, sf).where(F.col("symbol") == WAIT).select("event_id", F.row_number().over(w).cast("long").alias("aux_order"))


@query("SORT-01", f"SELECT event_id, row_number() OVER (PARTITION BY device_id ORDER BY start_ns, end_ns, stream_id, symbol, event_id) AS anchor_idx FROM {EV}")
def total_order(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "end_ns", "stream_id", "symbol", "event_id")
    return trace_event(spark, sf).select("event_id", F.row_number().over(w).cast("long").alias("anchor_idx"))


@query("SORT-02", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY start_ns, event_id) AS pos FROM {EV}), g AS (SELECT *, sum(CASE WHEN symbol = '{COMMUNICATION}' THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY pos) AS run FROM r)
 SELECT event_id, row_number() OVER (PARTITION BY device_id ORDER BY run, CASE WHEN symbol = '{COMMUNICATION}' THEN 0 ELSE 1 END, stream_id, event_id) AS new_pos FROM g""")
def safe_runs(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", "event_id")
    bar = F.when(F.col("symbol") == COMMUNICATION, 1).otherwise(0)
    g = trace_event(spark, sf).withColumn("run", F.sum(bar).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.select("event_id", F.row_number().over(Window.partitionBy("device_id").orderBy("run", 1 - bar, "stream_id", "event_id")).cast("long").alias("new_pos"))


@query("SORT-04", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_by(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SORT-05", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS top_order FROM orders GROUP BY 1")
def top1(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.col("o_totalprice") * 1000000 + F.col("o_orderkey")).alias("top_order"))


@query("SORT-06", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50")
def browse(spark, sf):
    return table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(50).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SORT-08", f"SELECT symbol, n, first_event FROM (SELECT symbol, count(*) AS n, min(event_id) AS first_event FROM {EV} GROUP BY 1) ORDER BY n DESC, first_event, symbol LIMIT 1")
def winner(spark, sf):
    return trace_event(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).orderBy(F.desc("n"), "first_event", "symbol").limit(1)


@query("SET-01", "SELECT o_orderkey AS id, 'order' AS kind FROM orders UNION ALL SELECT l_orderkey, 'line' FROM lineitem WHERE l_linenumber = 1")
def union_all(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    return a.unionByName(table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("kind")))


@query("SET-02", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SET-04", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def difference(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).exceptAll(table(spark, sf, "lineitem").where("l_quantity > 48").select("l_partkey").distinct())


@query("SET-05", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()


# -- scalar functions (2.9)


@query("FUN-string", "SELECT n_name, lower(n_name) AS low, substr(n_name, 2, 3) AS part, n_name || ':' || n_regionkey AS joined, nullif(n_name, 'FRANCE') AS maybe, n_name ILIKE 'a%' AS begins FROM nation")
def string_functions(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").select("n_name", F.lower(n).alias("low"), F.substring(n, 2, 3).alias("part"), F.concat(n, F.lit(":"), "n_regionkey").alias("joined"), F.nullif(n, F.lit("FRANCE")).alias("maybe"), n.ilike("a%").alias("begins"))


@query("FUN-format", "SELECT p_partkey, printf('%06d', p_partkey) AS padded, printf('%.3f', p_retailprice) AS price, repeat(' ', p_size % 5) || p_brand AS indented FROM part")
def format_functions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.format_string("%06d", "p_partkey").alias("padded"), F.format_string("%.3f", "p_retailprice").alias("price"), F.concat(F.repeat(F.lit(" "), F.col("p_size") % 5), "p_brand").alias("indented"))


@query("FUN-math", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 <> 0 THEN least(l_partkey, l_suppkey) END AS low, l_partkey // 7 AS whole, l_partkey >> 3 AS shifted, CASE WHEN l_suppkey <= l_partkey THEN CAST(floor(l_suppkey::HUGEINT * 1000000 // l_partkey) AS BIGINT) END AS ppm FROM lineitem WHERE l_partkey > 0")
def math_functions(spark, sf):
    x = table(spark, sf, "lineitem").where("l_partkey > 0")
    s = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey"))
    return x.select("l_orderkey", "l_linenumber", S.null_least(F.col("l_partkey"), s).alias("low"), F.expr("l_partkey div 7").alias("whole"), F.shiftright("l_partkey", 3).alias("shifted"), S.ppm(F.col("l_suppkey"), F.col("l_partkey")).alias("ppm"))


@query("FUN-json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_array_length('[1,2,3]') AS n FROM events")
def json_functions(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.json_array_length(F.lit("[1,2,3]")).cast("long").alias("n"))


@query("FUN-hash", "SELECT n_nationkey, sha256(n_name) AS sha2, sha1(n_name) AS sha1 FROM nation")
def hash_functions(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("sha2"), F.sha1("n_name").alias("sha1"))


@query("FUN-cast", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, TRY_CAST(left(o_orderpriority, 1) AS BIGINT) AS lead, TRY_CAST(o_orderstatus AS BIGINT) AS none FROM orders")
def cast_functions(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("t"), F.left("o_orderpriority", F.lit(1)).try_cast("long").alias("lead"), F.col("o_orderstatus").try_cast("long").alias("none"))
