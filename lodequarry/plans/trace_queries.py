"""Queries for rules, sequences, structure, replay, scheduler context, inference spans and clocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodequarry.functions import scalars as S
from lodequarry.operators import clock, collectives, rules
from lodequarry.operators import context as C
from lodequarry.operators import intervals as I
from lodequarry.operators import relations as R
from lodequarry.operators import sequence as Q
from lodequarry.operators import structure as T
from lodequarry.plans.core_queries import EV
from lodequarry.plans.registry import query
from lodequarry.sources.tables import COMMUNICATION, RUNTIME_CALL, TREE_EDGE, WAIT, runtime_call, table, trace_event, tree_edge

# -- rules


def _tasks(spark, sf):
    p = table(spark, sf, "part")
    kind = F.expr("CASE p_partkey % 7 WHEN 0 THEN 'EVENT_WAIT' WHEN 1 THEN 'AI_CORE' WHEN 2 THEN 'HIP_KERNEL' WHEN 3 THEN 'Model Execute' WHEN 4 THEN 'CUDA_KERNEL' WHEN 5 THEN '' ELSE p_type END")
    op = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'MatMulV2_' || md5(p_name) || '_1' WHEN 1 THEN 'ncclAllReduce' WHEN 2 THEN 'RmsNorm' WHEN 3 THEN p_name ELSE 'aiv_sync' END")
    who = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'ascend' WHEN 1 THEN 'cuda' ELSE 'hygon' END")
    return p.select("p_partkey", kind.alias("task_type"), op.alias("operator"), F.lower(F.concat_ws(" ", op, kind)).alias("blob"), who.alias("provider"))


_TASKS = """(SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'EVENT_WAIT' WHEN 1 THEN 'AI_CORE' WHEN 2 THEN 'HIP_KERNEL' WHEN 3 THEN 'Model Execute' WHEN 4 THEN 'CUDA_KERNEL' WHEN 5 THEN '' ELSE p_type END AS task_type,
 CASE p_partkey % 5 WHEN 0 THEN 'MatMulV2_' || md5(p_name) || '_1' WHEN 1 THEN 'ncclAllReduce' WHEN 2 THEN 'RmsNorm' WHEN 3 THEN p_name ELSE 'aiv_sync' END AS operator,
 CASE p_partkey % 3 WHEN 0 THEN 'ascend' WHEN 1 THEN 'cuda' ELSE 'hygon' END AS provider FROM part)"""


def _role_sql() -> str:
    """The rules as one CASE for DuckDB, generated from the same table of fixed values."""
    arms = []
    for r in rules.checked(rules.default_rules()):
        if r.domain != "task" or r.match == "numbered":
            continue
        value = "trim(regexp_replace(upper(task_type), '[^A-Z0-9]+', '_', 'g'), '_')" if r.field == "task_type" else "lower(operator)" if r.field == "operator" else "lower(concat_ws(' ', operator, task_type))"
        hit = f"{value} = '{r.pattern.upper() if r.field == 'task_type' else r.pattern.lower()}'" if r.match == "exact" else f"contains({value}, '{r.pattern.lower()}')"
        who = "TRUE" if r.provider == "any" else f"provider = '{r.provider}'"
        arms.append(f"WHEN {who} AND {hit} THEN '{r.role}'")
    return f"SELECT p_partkey, CASE {' '.join(arms)} ELSE 'unknown_anchor' END AS role FROM {_TASKS}"


@query("RUL-01", _role_sql())
def roles(spark, sf):
    return rules.classified(_tasks(spark, sf), rules.checked(rules.default_rules())).select("p_partkey", "role")


@query("PRJ-06", f"SELECT p_partkey FROM ({_role_sql()}) WHERE role <> 'auxiliary'")
def without_auxiliary(spark, sf):
    return roles(spark, sf).where("role <> 'auxiliary'").select("p_partkey")


@query("RUL-02")
def role_overrides(spark, sf):
    over = [rules.RoleRule(100, "any", "task", "blob", "contains", "brass", "anchor", ("blob",))]
    both = rules.checked(rules.overridden(rules.default_rules(), over))
    return rules.classified(_tasks(spark, sf), both).groupBy("role", "rule", "support_state").agg(F.count("*").alias("n"))


@query("RUL-03", f"""SELECT p_partkey, CASE WHEN contains(lower(operator), 'allreduce') THEN 'AllReduce' ELSE operator END AS structural_symbol, CASE WHEN contains(lower(operator), 'allreduce') THEN 'canonicalized' ELSE 'identity' END AS outcome FROM {_TASKS}""")
def symbols(spark, sf):
    return rules.normalised(_tasks(spark, sf), rules.COLLECTIVE_SYMBOLS, "operator", "provider").select("p_partkey", "structural_symbol", "outcome")


@query("RUL-04", f"SELECT p_partkey, CASE WHEN regexp_matches(operator, '^[^_]+_[A-Za-z0-9]{{32}}(_|$)') THEN regexp_extract(operator, '^([^_]+)_', 1) END AS base FROM {_TASKS}")
def kernel_bases(spark, sf):
    return _tasks(spark, sf).select("p_partkey", rules.kernel_base(F.col("operator")).alias("base"))


@query("RUL-05", f"""WITH o AS (SELECT *, start_ns // 3600000000000 AS h FROM {EV} WHERE symbol IN ('{WAIT}', '{COMMUNICATION}')), g AS (SELECT device_id, stream_id, h, count(*) FILTER (symbol = '{WAIT}') AS gn, count(*) FILTER (symbol = '{COMMUNICATION}') AS cn,
 max(start_ns) FILTER (symbol = '{WAIT}') AS gs, max(end_ns) FILTER (symbol = '{WAIT}') AS ge, max(start_ns) FILTER (symbol = '{COMMUNICATION}') AS cs, max(end_ns) FILTER (symbol = '{COMMUNICATION}') AS ce FROM o GROUP BY 1, 2, 3)
 SELECT event_id, CASE WHEN gn = 1 AND cn = 1 THEN CASE WHEN ce > cs AND greatest(0, least(ge, ce) - greatest(gs, cs)) / (ce - cs) >= 0.5 THEN 'reconciled' ELSE 'conflict' END WHEN gn > 0 AND cn > 0 THEN 'ambiguous' ELSE 'independent' END AS status FROM o JOIN g USING (device_id, stream_id, h)""")
def reconciliation(spark, sf):
    e = trace_event(spark, sf).where(F.col("symbol").isin(WAIT, COMMUNICATION)).withColumn("h", F.expr("start_ns div 3600000000000"))
    return rules.reconciled(e, ["device_id", "stream_id", "h"], F.col("symbol") == WAIT, F.col("symbol") == COMMUNICATION, 0.5).select("event_id", "status")


@query("RUL-07", f"""SELECT e.event_id, CASE WHEN e.symbol = '{WAIT}' THEN 'explicit_skip' WHEN e.symbol <> '{COMMUNICATION}' AND EXISTS (SELECT 1 FROM {EV} c WHERE c.symbol = '{COMMUNICATION}' AND c.device_id = e.device_id AND c.stream_id = e.stream_id AND c.start_ns <= e.start_ns AND c.end_ns >= e.end_ns) THEN 'represented_by_communication' WHEN e.symbol = '{COMMUNICATION}' THEN 'anchor' ELSE 'policy_role' END AS decision FROM {EV} e""")
def decisions(spark, sf):
    e = trace_event(spark, sf)
    comm = e.where(F.col("symbol") == COMMUNICATION).select("device_id", "stream_id", "event_id", "start_ns", "end_ns")
    other = e.where(F.col("symbol") != COMMUNICATION).select("device_id", "stream_id", "event_id", "start_ns", "end_ns")
    shown = I.containment_join(comm, other, ["device_id", "stream_id"]).select(F.col("r_event_id").alias("event_id")).distinct().withColumn("shown", F.lit(True))
    met = e.join(shown, "event_id", "left")
    return met.select("event_id", F.when(F.col("symbol") == WAIT, "explicit_skip").when(F.col("shown"), "represented_by_communication").when(F.col("symbol") == COMMUNICATION, "anchor").otherwise("policy_role").alias("decision"))


# -- sequences


@query("WIN-13", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY start_ns, event_id) - 1 AS pos, CASE WHEN lag(symbol) OVER (PARTITION BY device_id ORDER BY start_ns, event_id) = symbol THEN 0 ELSE 1 END AS c FROM {EV}),
 b AS (SELECT *, sum(c) OVER (PARTITION BY device_id ORDER BY pos) - 1 AS run FROM a) SELECT device_id, CAST(run AS BIGINT) AS run, any_value(symbol) AS symbol, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS length FROM b GROUP BY 1, 2""")
def symbol_runs(spark, sf):
    return Q.long_runs(trace_event(spark, sf), ["device_id"], ["start_ns", "event_id"], "symbol")


@query("SEQ-01", f"SELECT device_id, count(*) AS tokens, count(DISTINCT symbol) AS symbols FROM {EV} WHERE symbol <> '{WAIT}' GROUP BY 1")
def tokens(spark, sf):
    return trace_event(spark, sf).where(F.col("symbol") != WAIT).groupBy("device_id").agg(F.count("*").alias("tokens"), F.count_distinct("symbol").alias("symbols"))


_GRAMS = f"""WITH s AS (SELECT device_id, row_number() OVER w - 1 AS p, symbol AS a, lead(symbol, 1) OVER w AS b, lead(symbol, 2) OVER w AS c FROM {EV} WINDOW w AS (PARTITION BY device_id ORDER BY start_ns, event_id)),
 g AS (SELECT device_id, p AS first_pos, p + 1 AS last_pos, 2 AS length, a || '>' || b AS gram FROM s WHERE b IS NOT NULL UNION ALL SELECT device_id, p, p + 2, 3, a || '>' || b || '>' || c FROM s WHERE c IS NOT NULL)"""


def _grams(spark, sf):
    return Q.ngrams(trace_event(spark, sf), ["device_id"], ["start_ns", "event_id"], "symbol", 2, 3)


@query("SEQ-03", _GRAMS + " SELECT device_id, gram, count(*) AS n, min(first_pos) AS first_pos FROM g GROUP BY 1, 2 HAVING count(*) > 1")
def ngram_candidates(spark, sf):
    return _grams(spark, sf).groupBy("device_id", "gram").agg(F.count("*").alias("n"), F.min("first_pos").alias("first_pos")).where("n > 1")


def _protected(spark, sf):
    n = table(spark, sf, "nation")
    return n.select((F.col("n_nationkey") % 4).cast("long").alias("device_id"), F.col("n_nationkey").alias("interval_id"), (F.col("n_nationkey") * 100).alias("first_token"), (F.col("n_nationkey") * 100 + 40).alias("last_token"), F.expr("CASE n_regionkey % 3 WHEN 0 THEN 'no_cross' WHEN 1 THEN 'allow_enclosing' ELSE 'block_any_overlap' END").alias("policy"))


_VIOLATIONS = _GRAMS + """, i AS (SELECT n_nationkey % 4 AS device_id, n_nationkey AS interval_id, n_nationkey * 100 AS s, n_nationkey * 100 + 40 AS e, CASE n_regionkey % 3 WHEN 0 THEN 'no_cross' WHEN 1 THEN 'allow_enclosing' ELSE 'block_any_overlap' END AS policy FROM nation),
 v AS (SELECT g.device_id, g.first_pos, g.length, g.gram, min(i.interval_id) FILTER (g.first_pos <= i.e AND g.last_pos >= i.s AND CASE policy WHEN 'block_any_overlap' THEN TRUE WHEN 'allow_enclosing' THEN NOT (g.first_pos >= i.s AND g.last_pos <= i.e) AND NOT (g.first_pos <= i.s AND g.last_pos >= i.e) ELSE NOT (g.first_pos >= i.s AND g.last_pos <= i.e) END) AS violates
 FROM g LEFT JOIN i ON i.device_id = g.device_id GROUP BY 1, 2, 3, 4)"""


@query("SEQ-04", _VIOLATIONS + " SELECT device_id, first_pos, length, violates FROM v WHERE violates IS NOT NULL")
def boundary_violations(spark, sf):
    return Q.violations(_grams(spark, sf), _protected(spark, sf), ["device_id"]).where("violates is not null").select("device_id", "first_pos", "length", "violates")


@query("SEQ-05", _VIOLATIONS + " SELECT gram, count(*) AS n FROM v WHERE gram NOT IN (SELECT gram FROM v WHERE violates IS NOT NULL) GROUP BY 1")
def ambiguous_blocked(spark, sf):
    v = Q.violations(_grams(spark, sf), _protected(spark, sf), ["device_id"])
    return Q.unblocked(v, v.where("violates is not null")).groupBy("gram").agg(F.count("*").alias("n"))


@query("SEQ-06")
def grammar(spark, sf):
    return Q.folded(trace_event(spark, sf), "device_id", ["start_ns", "event_id"], "symbol", 50_000).groupBy("device_id", "status").agg(F.count("*").alias("nodes"), F.max(F.col("last_pos") - F.col("first_pos") + 1).alias("longest"))


@query("SEQ-12")
def grammar_by_stream(spark, sf):
    return Q.folded(trace_event(spark, sf), "stream_id", ["start_ns", "event_id"], "symbol")


@query("SEQ-13")
def periodic_suffixes(spark, sf):
    import pandas as pd

    def find(pdf):
        got = Q.periodic_suffix((pdf.sort_values(["start_ns", "event_id"])["symbol"] == WAIT).tolist())
        start, period, repeats, rest = got or (None,) * 4
        return pd.DataFrame({"device_id": [pdf["device_id"].iloc[0]], "start": [start], "period": [period], "repeats": [repeats], "rest": [rest]}).astype("Int64")

    return trace_event(spark, sf).select("device_id", "start_ns", "event_id", "symbol").groupBy("device_id").applyInPandas(find, "device_id long, start long, period long, repeats long, rest long")


@query("SEQ-14")
def motifs(spark, sf):
    import pandas as pd

    def find(pdf):
        m = Q.primitive(pdf.sort_values("turn")["role"].tolist())
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "motif": [">".join(m)], "times": [len(pdf) // max(1, len(m))]})

    return table(spark, sf, "conversations").select("conv_id", "turn", "role").groupBy("conv_id").applyInPandas(find, "conv_id long, motif string, times long")


@query("SEQ-17", "SELECT o_custkey, min(o_orderstatus) AS partition_id FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def partition_ids(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("partition_id"), F.count_distinct("o_orderstatus").alias("n")).where("n = 1").drop("n")


@query("SEQ-18", """WITH l AS (SELECT o_orderkey, o_orderpriority AS signature, o_custkey % 3 AS member, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 3 ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders),
 m AS (SELECT signature, min(member) AS lead FROM l GROUP BY 1) SELECT l.signature, l.ordinal, f.o_orderkey AS first_loop, l.member, l.o_orderkey AS loop FROM l JOIN m USING (signature) JOIN l f ON f.signature = l.signature AND f.member = m.lead AND f.ordinal = l.ordinal WHERE l.member <> m.lead""")
def loop_pairs(spark, sf):
    loops = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("signature"), (F.col("o_custkey") % 3).alias("member"), "o_orderdate")
    return collectives.loop_pairs(loops, "signature", "member", ["o_orderdate", "o_orderkey"], "o_orderkey").withColumn("ordinal", F.col("ordinal").cast("long"))


@query("AGG-22", f"""WITH m AS (SELECT start_ns // 7200000000000 AS call, symbol, device_id, start_ns, end_ns FROM {EV} WHERE symbol = '{COMMUNICATION}'), w AS (SELECT symbol, count(DISTINCT device_id) AS n FROM m GROUP BY 1),
 s AS (SELECT call, symbol, count(DISTINCT device_id) AS n_members, max(start_ns) - min(start_ns) AS start_skew_ns, max(end_ns - start_ns) - min(end_ns - start_ns) AS duration_skew_ns FROM m GROUP BY 1, 2)
 SELECT call, s.symbol, n_members, w.n - n_members AS n_missing, start_skew_ns, duration_skew_ns, CASE WHEN n_members = 1 THEN 'singleton' WHEN n_members = w.n THEN 'complete' ELSE 'partial' END AS status,
 CASE WHEN n_members = 1 THEN 0.35 WHEN n_members = w.n THEN 0.85 ELSE 0.55 END::DOUBLE AS confidence FROM s JOIN w USING (symbol)""")
def collective_summaries(spark, sf):
    m = trace_event(spark, sf).where(F.col("symbol") == COMMUNICATION).withColumn("call", F.expr("start_ns div 7200000000000"))
    return collectives.summaries(m, ["call"], "device_id", m.select("symbol", "device_id"), "symbol")


# -- structure


@query("JOIN-24", f"""WITH RECURSIVE e AS (SELECT * FROM {TREE_EDGE}), t AS (SELECT 'world' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 'world' AS path UNION ALL SELECT e.child, e.parent, t.depth + 1, t.path || '/' || e.child FROM t JOIN e ON e.parent = t.node) SELECT node, parent, depth, path FROM t""")
def tree_walk(spark, sf):
    return T.walk(tree_edge(spark, sf)).select("node", "parent", "depth", "path")


@query("AGG-19", """SELECT node, CAST(sum(v) AS BIGINT) AS orders FROM (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 'r' || n_regionkey AS c, n AS v FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) t,
 LATERAL (SELECT unnest([a, b, c, 'world']) AS node) GROUP BY 1""")
def tree_sums(spark, sf):
    leaves = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("node"))
    return T.rolled_up(T.walk(tree_edge(spark, sf)), leaves, {"orders": F.count("*")})


@query("STC-01", """WITH o AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations),
 r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS run FROM o), n AS (SELECT conv_id, run, count(*) AS length FROM r GROUP BY 1, 2)
 SELECT conv_id, 'root' AS kind, count(DISTINCT conv_id) AS n FROM r GROUP BY 1 UNION ALL SELECT conv_id, 'repeat', count(*) FROM n WHERE length >= 2 GROUP BY 1 UNION ALL SELECT conv_id, 'atom', count(*) FROM r GROUP BY 1""")
def run_tree(spark, sf):
    runs = Q.runs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role")
    return T.folded_runs(runs, ["conv_id"]).groupBy("conv_id", "kind").agg(F.count("*").alias("n"))


@query("STC-02")
def grammar_tree(spark, sf):
    return Q.folded_trees(trace_event(spark, sf), "stream_id", ["start_ns", "event_id"], "symbol")


@query("STC-04", "SELECT CAST(NULL AS VARCHAR) AS node, CAST(NULL AS VARCHAR) AS fault WHERE FALSE")
def tree_faults(spark, sf):
    return T.faults(T.folded_runs(Q.runs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role"), ["conv_id"]))


@query("STC-05", """WITH s AS (SELECT o_orderpriority, o_orderkey, string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_returnflag) AS sig FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
 SELECT o_orderpriority, count(*) AS occurrences, count(DISTINCT sig) AS signatures, count(DISTINCT sig) = 1 AS agrees, min(sig) AS slots FROM s GROUP BY 1""")
def position_model(spark, sf):
    x = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return T.agreed_slots(x, "o_orderpriority", "o_orderkey", ["l_linenumber"], "l_returnflag")


@query("STC-06", f"SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS ordinal FROM {TREE_EDGE}")
def edge_ordinals(spark, sf):
    return T.ordinals(tree_edge(spark, sf), ["parent"], ["child"]).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("WIN-11", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS ordinal FROM customer")
def ordinal_in_role(spark, sf):
    return T.ordinals(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], "c_mktsegment").select("c_custkey", F.col("ordinal").cast("long").alias("ordinal"))


@query("STC-07", f"""WITH t AS (SELECT symbol, stream_id, count(*) AS n, CAST(sum(end_ns - start_ns) AS BIGINT) AS ns FROM {EV} GROUP BY 1, 2) SELECT symbol, stream_id, round(ns / 1000.0 / n, 3) AS avg_us FROM t""")
def node_averages(spark, sf):
    t = trace_event(spark, sf).groupBy("symbol", "stream_id").agg(F.count("*").alias("n"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("ns"))
    return t.select("symbol", "stream_id", T.per_repeat(F.col("ns") / 1000.0, F.col("n"), F.lit(None).cast("long")).alias("avg_us"))


@query("STC-08", f"""WITH RECURSIVE e AS (SELECT * FROM {TREE_EDGE}), t AS (SELECT 'world' AS node, 0 AS depth UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.node), n AS (SELECT parent, count(*) AS k FROM e GROUP BY 1)
 SELECT node, depth, repeat('  ', depth) || node || ' (' || coalesce(k, 0) || ')' AS line FROM t LEFT JOIN n ON n.parent = t.node""")
def readable_tree(spark, sf):
    return T.readable(T.walk(tree_edge(spark, sf)))


@query("STC-10", f"SELECT device_id, count(*) AS tokens, min(start_ns) AS first_ns, max(end_ns) AS last_ns FROM {EV} GROUP BY 1")
def by_device(spark, sf):
    return trace_event(spark, sf).groupBy("device_id").agg(F.count("*").alias("tokens"), F.min("start_ns").alias("first_ns"), F.max("end_ns").alias("last_ns"))


@query("CST-09", """WITH o AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) SELECT conv_id || ':atom:' || pos AS node, role AS symbol FROM o""")
def cost_handoff(spark, sf):
    return T.folded_runs(Q.runs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role"), ["conv_id"]).where("kind = 'atom'").select("node", "symbol")


# -- replay


_CALLS = f"(SELECT *, api_name = 'api1-URGENT' AS is_sync FROM {RUNTIME_CALL})"


@query("REP-02", f"""WITH c AS (SELECT *, coalesce(sum(CASE WHEN is_sync THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY start_ns, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {_CALLS} WHERE api_name IN ('api1-URGENT', 'api2-HIGH')),
 a AS (SELECT thread_id, g, count(*) FILTER (NOT is_sync) AS launches, min(start_ns) FILTER (NOT is_sync) AS first_start_ns, max(start_ns) FILTER (NOT is_sync) AS last_start_ns, bool_or(is_sync) AS closed_by_sync FROM c GROUP BY 1, 2)
 SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY g) - 1 AS activity, launches, first_start_ns, last_start_ns, closed_by_sync FROM a WHERE launches > 0""")
def launch_activities(spark, sf):
    out = R.activities(runtime_call(spark, sf), ["thread_id"], ["start_ns", "call_id"], F.col("api_name") == "api2-HIGH", F.col("api_name") == "api1-URGENT")
    return out.withColumn("activity", F.col("activity").cast("long"))


@query("REP-03", """SELECT o_orderkey, string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_returnflag) AS signature, count(*) AS members, sha256(string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_returnflag)) AS template FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def body_templates(spark, sf):
    x = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return R.signatures(x, ["o_orderkey"], ["l_linenumber"], "l_returnflag").withColumn("members", F.col("members").cast("long"))


@query("REP-04")
def compositions(spark, sf):
    import pandas as pd

    def find(pdf):
        ids = pdf.sort_values(["start_ns", "call_id"])["api_name"].tolist()
        got = Q.periodic_suffix(ids)
        head, period, repeats, tail = got or (len(ids), 0, 0, 0)
        return pd.DataFrame({"thread_id": [pdf["thread_id"].iloc[0]], "head": [head], "layer": [period], "repeats": [repeats], "tail": [tail], "status": ["recognized" if got else "incomplete"]})

    return runtime_call(spark, sf).select("thread_id", "start_ns", "call_id", "api_name").groupBy("thread_id").applyInPandas(find, "thread_id long, head long, layer long, repeats long, tail long, status string")


@query("REP-08", f"""WITH l AS (SELECT device_id, end_ns, lead(start_ns) OVER (PARTITION BY device_id, stream_id ORDER BY start_ns, event_id) AS nxt, stream_id FROM {EV}) SELECT device_id, stream_id, bool_and(coalesce(nxt >= end_ns, TRUE)) AS direct FROM l GROUP BY 1, 2""")
def direct_candidates(spark, sf):
    w = Window.partitionBy("device_id", "stream_id").orderBy("start_ns", "event_id")
    return trace_event(spark, sf).withColumn("nxt", F.lead("start_ns").over(w)).groupBy("device_id", "stream_id").agg(F.bool_and(F.coalesce(F.col("nxt") >= F.col("end_ns"), F.lit(True))).alias("direct"))


@query("REP-09", f"""WITH b AS (SELECT thread_id, start_ns, row_number() OVER (PARTITION BY thread_id ORDER BY start_ns) - 1 AS slot FROM {RUNTIME_CALL} WHERE api_name = 'api3-MEDIUM'), e AS (SELECT thread_id, end_ns, row_number() OVER (PARTITION BY thread_id ORDER BY end_ns) - 1 AS slot FROM {RUNTIME_CALL} WHERE api_name = 'api5-LOW')
 SELECT thread_id, slot, start_ns, end_ns FROM b JOIN e USING (thread_id, slot) WHERE end_ns > start_ns""")
def capture_intervals(spark, sf):
    c = runtime_call(spark, sf)
    begin = c.where("api_name = 'api3-MEDIUM'").select("thread_id", F.lit("begin").alias("kind"), F.col("start_ns").alias("at_ns"))
    end = c.where("api_name = 'api5-LOW'").select("thread_id", F.lit("end").alias("kind"), F.col("end_ns").alias("at_ns"))
    return R.capture_intervals(begin.union(end), ["thread_id"]).withColumn("slot", F.col("slot").cast("long"))


@query("REP-11")
def body_patterns(spark, sf):
    return Q.folded(table(spark, sf, "lineitem").withColumn("domain", F.col("l_suppkey") % 8), "domain", ["l_orderkey", "l_linenumber", "l_partkey"], "l_returnflag").groupBy("domain", "symbol", "expansion").agg(F.count("*").alias("occurrences"))


_PART = f"""WITH c AS (SELECT device_id, event_id AS replay, start_ns, end_ns, row_number() OVER (PARTITION BY device_id ORDER BY start_ns, event_id) AS k FROM {EV} WHERE symbol = '{COMMUNICATION}')
 SELECT e.device_id, (SELECT coalesce(max(k), 0) FROM c WHERE c.device_id = e.device_id AND c.start_ns <= e.start_ns) AS segment, count(*) AS events, CAST(sum(e.end_ns - e.start_ns) AS BIGINT) AS total_ns FROM {EV} e WHERE e.symbol <> '{COMMUNICATION}' GROUP BY 1, 2"""


@query("AGG-30", _PART)
def replay_partition(spark, sf):
    w = Window.partitionBy("device_id").orderBy("start_ns", F.when(F.col("symbol") == COMMUNICATION, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = trace_event(spark, sf).withColumn("segment", F.sum(F.when(F.col("symbol") == COMMUNICATION, 1).otherwise(0)).over(w))
    return e.where(F.col("symbol") != COMMUNICATION).groupBy("device_id", "segment").agg(F.count("*").alias("events"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("total_ns"))


@query("AGG-31", f"""WITH m AS (SELECT g.event_id AS g, e.event_id AS t, e.end_ns - e.start_ns AS d FROM {EV} g JOIN {EV} e ON e.device_id = g.device_id AND e.stream_id = g.stream_id AND e.start_ns >= g.start_ns AND e.end_ns <= g.end_ns AND g.symbol = '{COMMUNICATION}' AND e.symbol <> '{COMMUNICATION}'),
 o AS (SELECT *, count(*) OVER (PARTITION BY t) AS owners FROM m) SELECT g AS graph_id, count(*) AS children, CAST(sum(d) AS BIGINT) AS child_ns FROM o WHERE owners = 1 GROUP BY 1""")
def graph_children(spark, sf):
    e = trace_event(spark, sf).select("device_id", "stream_id", "event_id", "start_ns", "end_ns", "symbol")
    met = I.containment_join(e.where(F.col("symbol") == COMMUNICATION), e.where(F.col("symbol") != COMMUNICATION), ["device_id", "stream_id"])
    one = met.withColumn("owners", F.count("*").over(Window.partitionBy("r_event_id"))).where("owners = 1")
    return one.groupBy(F.col("event_id").alias("graph_id")).agg(F.count("*").alias("children"), F.sum(F.col("r_end_ns") - F.col("r_start_ns")).alias("child_ns"))


# -- host windows, context, inference


@query("CTX-03", f"""WITH a AS (SELECT e.event_id AS anchor_id, e.device_id, e.start_ns, c.start_ns AS cs, c.end_ns AS ce, c.process_id AS p, c.thread_id AS t FROM {EV} e LEFT JOIN {RUNTIME_CALL} c ON c.call_id = e.event_id AND c.call_id % 3 <> 0),
 l AS (SELECT lag(anchor_id) OVER w AS left_anchor_id, anchor_id AS right_anchor_id, lag(ce) OVER w AS hs, cs AS he, lag(p) OVER w = p AS sp, lag(t) OVER w = t AS st FROM a WINDOW w AS (PARTITION BY device_id ORDER BY start_ns, anchor_id))
 SELECT left_anchor_id, right_anchor_id, CASE WHEN sp AND st THEN 'same_thread' WHEN sp THEN 'same_process' ELSE 'any' END AS scope_policy, CASE WHEN hs IS NULL OR he IS NULL THEN 'missing_endpoint' WHEN he < hs THEN 'nonmonotonic_host_order' ELSE 'supported_ordered' END AS support_state FROM l WHERE left_anchor_id IS NOT NULL""")
def host_windows(spark, sf):
    c = runtime_call(spark, sf).where("call_id % 3 <> 0").select(F.col("call_id").alias("event_id"), F.col("start_ns").alias("call_start"), F.col("end_ns").alias("call_end"), "process_id", "thread_id")
    a = trace_event(spark, sf).join(c, "event_id", "left").withColumnRenamed("event_id", "anchor_id")
    return R.host_intervals(a, ["device_id"], ["start_ns", "anchor_id"]).select("left_anchor_id", "right_anchor_id", "scope_policy", "support_state")


@query("CTX-02", f"SELECT DISTINCT e.device_id, c.process_id FROM {EV} e JOIN {RUNTIME_CALL} c ON c.call_id = e.event_id")
def endpoint_links(spark, sf):
    return trace_event(spark, sf).join(runtime_call(spark, sf).select(F.col("call_id").alias("event_id"), "process_id"), "event_id").select("device_id", "process_id").distinct()


def _records(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    body = F.struct(F.lit("v1").alias("schema"), F.lit("step").alias("type"), F.lit("run").alias("run_id"), F.lit("p").alias("producer_id"), F.col("conv_id").cast("string").alias("step_id"), F.col("conv_id").alias("ordinal"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total_scheduled_tokens"), F.transform("t", lambda x: F.struct(x["turn"].cast("string").alias("request_id"), x["n"].cast("long").alias("scheduled_tokens"), F.lit(100).cast("long").alias("scheduled_token_start"), F.when(x["turn"] != 3, (x["n"] % 3 * 100).cast("long")).alias("prompt_tokens"))).alias("requests"))
    return C.records(c.select(F.to_json(body).alias("value")))


_REQ = """SELECT 'run' AS run_id, CAST(conv_id AS VARCHAR) AS step_id, CAST(turn AS VARCHAR) AS request_id, length(text) AS n, CASE WHEN turn <> 3 THEN least(length(text), greatest(0, length(text) % 3 * 100 - 100)) END AS p FROM conversations"""
_PHASE = "CASE WHEN p IS NULL THEN 'unknown' WHEN n = 0 THEN 'no_tokens' WHEN p = n THEN 'prefill' WHEN p = 0 THEN 'decode' ELSE 'mixed' END"


@query("CTX-04", "SELECT CAST(conv_id AS VARCHAR) AS step_id, count(*) AS scheduled_requests, CAST(sum(length(text)) AS BIGINT) AS total_scheduled_tokens, TRUE AS adds_up FROM conversations GROUP BY 1")
def scheduler_steps(spark, sf):
    return C.steps(_records(spark, sf)).select("step_id", "scheduled_requests", "total_scheduled_tokens", "adds_up")


@query("CTX-09", f"SELECT step_id, request_id, p AS prompt_part, n - p AS generated_part, {_PHASE} AS phase FROM ({_REQ})")
def request_phases(spark, sf):
    return C.requests(C.steps(_records(spark, sf))).select("step_id", "request_id", "prompt_part", "generated_part", "phase")


@query("AGG-25", f"""WITH q AS ({_REQ}), s AS (SELECT step_id, count(*) AS k, count(p) AS c, sum(p) AS p, sum(n - p) AS g, sum(n) AS n FROM q GROUP BY 1)
 SELECT step_id, CASE WHEN c <> k THEN 'unknown' WHEN p > 0 AND g = 0 THEN 'prefill' WHEN p = 0 AND g > 0 THEN 'decode' WHEN p > 0 AND g > 0 THEN 'mixed' ELSE 'unknown' END AS step_kind, CASE WHEN k = 1 AND n = 1 THEN 'single_request_single_token' WHEN k = 1 THEN 'single_request_other_tokens' ELSE 'multiple_requests' END AS step_shape FROM s""")
def step_kinds(spark, sf):
    s = C.steps(_records(spark, sf))
    return C.step_kinds(s, C.requests(s)).select("step_id", "step_kind", "step_shape")


@query("CTX-05", """WITH m AS (SELECT c_nationkey, count(*) AS n, min(c_custkey) AS one FROM customer WHERE c_acctbal < -900 GROUP BY 1) SELECT s_suppkey, CASE WHEN n = 1 THEN one END AS marker, CASE WHEN s_suppkey % 5 = 0 THEN 'unavailable' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'supported' END AS marker_state FROM supplier LEFT JOIN m ON c_nationkey = s_nationkey""")
def marker_binding(spark, sf):
    m = table(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("s_nationkey"), "c_custkey")
    return C.bound(table(spark, sf, "supplier"), m, "s_nationkey", "c_custkey", F.col("s_suppkey") % 5 != 0).select("s_suppkey", "marker", "marker_state")


@query("CTX-07", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1) OR l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1)")
def unambiguous(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    by_order = C.unique_by(x, ["l_orderkey"], ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    one = x.groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n = 1").select("l_suppkey")
    many = x.join(x.groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n > 1").select("l_orderkey"), "l_orderkey", "left_semi")
    return by_order.select("l_orderkey", "l_linenumber").unionByName(many.join(one, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber"))


@query("CTX-10", f"""WITH w AS (SELECT event_id % 50 AS step_id, * FROM {EV}), p AS (SELECT *, max(end_ns) OVER (PARTITION BY step_id, device_id ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM w),
 c AS (SELECT step_id, device_id, count(*) AS linked_work, CAST(sum(greatest(0, end_ns - greatest(start_ns, coalesce(prior, start_ns)))) AS BIGINT) AS union_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS sum_ns, max(end_ns) - min(start_ns) AS envelope_ns FROM p GROUP BY 1, 2)
 SELECT s.step_id, device_id, coalesce(linked_work, 0) AS linked_work, union_ns, sum_ns, envelope_ns FROM (SELECT unnest(range(0, 60)) AS step_id) s LEFT JOIN c USING (step_id)""")
def step_costs(spark, sf):
    e = trace_event(spark, sf).select((F.col("event_id") % 50).alias("step_id"), "device_id", F.col("event_id").alias("work_id"), "start_ns", "end_ns")
    return C.step_costs(spark.range(60).select(F.col("id").alias("step_id")), e, ["step_id"])


def _span_events(spark, sf):
    c = table(spark, sf, "conversations")
    base = [F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), (F.col("conv_id") % 3).alias("producer_id"), F.lit(0).alias("clock_id")]
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    start = c.where("turn % 7 <> 6").select(*base, F.concat_ws(":", F.lit("s"), "conv_id", "turn").alias("event_id"), F.lit("span_start").alias("event_type"), (F.col("turn") * 2).alias("sequence"), (F.col("turn") * 1000).alias("at_ns"), parent.alias("parent_span_id"), F.col("role").alias("name"), F.lit("llm").alias("kind"), F.lit(None).cast("string").alias("status"))
    end = c.where("turn % 5 <> 4").select(*base, F.concat_ws(":", F.lit("e"), "conv_id", "turn").alias("event_id"), F.lit("span_end").alias("event_type"), (F.col("turn") * 2 + 1).alias("sequence"), (F.col("turn") * 1000 + F.length("text")).alias("at_ns"), F.lit(None).cast("long").alias("parent_span_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit("ok").alias("status"))
    done = c.where("turn = 0 and conv_id % 2 = 0").select(*base, F.concat_ws(":", F.lit("t"), "conv_id").alias("event_id"), F.lit("trace_end").alias("event_type"), F.lit(999).cast("long").alias("sequence"), F.lit(0).cast("long").alias("at_ns"), F.lit(None).cast("long").alias("parent_span_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit("ok").alias("status"))
    return start.unionByName(end).unionByName(done)


_SPAN = """SELECT conv_id AS trace_id, turn AS span_id, turn % 7 <> 6 AS has_start, turn % 5 <> 4 AS has_end, CASE WHEN turn % 7 = 6 THEN 'missing_start' WHEN turn % 5 = 4 THEN 'open' ELSE 'ok' END AS status,
 CASE WHEN turn % 7 <> 6 AND turn % 5 <> 4 THEN length(text) END AS duration_ns, CASE WHEN turn % 7 <> 6 THEN role ELSE 'unobserved' END AS name FROM conversations WHERE turn % 7 <> 6 OR turn % 5 <> 4"""


@query("CTX-13", _SPAN)
def span_assembly(spark, sf):
    return C.spans(_span_events(spark, sf)).select("trace_id", "span_id", "has_start", "has_end", "status", "duration_ns", "name")


@query("CTX-15", f"""WITH s AS ({_SPAN}), w AS (SELECT trace_id, bool_and(has_start AND has_end) AS whole, bool_or(span_id = 0 AND has_start AND has_end) AS root FROM s GROUP BY 1)
 SELECT trace_id, CASE WHEN trace_id % 2 = 1 THEN 'live_or_incomplete' WHEN NOT whole OR NOT root THEN 'finished_with_incomplete_spans' ELSE 'finished_observed' END AS state FROM w""")
def trace_states(spark, sf):
    e = _span_events(spark, sf)
    return C.trace_states(C.spans(e), e)


@query("CTX-15-links", f"""WITH s AS ({_SPAN}) SELECT l.trace_id, l.span_id, l.span_id - 1 AS source, CASE WHEN NOT coalesce(p.has_start AND p.has_end, FALSE) OR NOT l.has_end THEN 'incomplete' ELSE 'observed_same_clock' END AS timing_state FROM s l LEFT JOIN s p ON p.trace_id = l.trace_id AND p.span_id = l.span_id - 1 WHERE l.span_id > 0""")
def dependency_states(spark, sf):
    span = C.spans(_span_events(spark, sf))
    links = span.where("span_id > 0").select("trace_id", "span_id", (F.col("span_id") - 1).alias("source"))
    return C.dependencies(links, span)


@query("CTX-14", f"""WITH s AS ({_SPAN}) SELECT trace_id, span_id, CAST(sum(coalesce(duration_ns, 0)) OVER (PARTITION BY trace_id, g ORDER BY span_id) AS BIGINT) AS path_ns FROM (SELECT *, span_id - row_number() OVER (PARTITION BY trace_id ORDER BY span_id) AS g FROM s)""")
def longest_paths(spark, sf):
    span = C.spans(_span_events(spark, sf)).withColumn("parent_span_id", F.lit(None).cast("long"))
    links = span.where("span_id > 0").select("trace_id", "span_id", (F.col("span_id") - 1).alias("source"))
    return C.longest_paths(span, links).select("trace_id", "span_id", "path_ns")


@query("CTX-16")
def clock_models(spark, sf):
    n = table(spark, sf, "supplier").select((F.col("s_suppkey") % 4).alias("rank"), (F.col("s_suppkey") * 1_000_000 + 1_700_000_000_000_000_000).alias("source"), (F.expr("s_suppkey * 1000020 + s_suppkey % 3") + 1_700_000_000_000_500_000).alias("target"))
    return clock.fitted(n, ["rank"], "source", "target")


@query("CTX-11", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'embedded' WHEN o_orderstatus = 'P' THEN 'synthetic' ELSE 'unresolved' END AS resolution FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def locators(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.when(F.col("hit"), "embedded").when(F.col("o_orderstatus") == "P", "synthetic").otherwise("unresolved").alias("resolution"))


@query("CTX-12", "SELECT l_orderkey + 3 AS locator FROM lineitem WHERE l_orderkey + 3 NOT IN (SELECT o_orderkey FROM orders)")
def locator_check(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") + 3).alias("locator")).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("locator")), "locator", "left_anti")


@query("STR-04", "SELECT event_id, user_id FROM events")
def deduplicated(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return e.unionByName(e.where("event_id % 3 = 0")).dropDuplicates(["event_id"])


@query("STR-05", "SELECT conv_id, role FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", "role")


@query("SNK-11", f"""WITH d AS (SELECT *, count(*) OVER (PARTITION BY device_id, stream_id, start_ns, end_ns) AS n FROM {EV}) SELECT event_id, n > 1 AS folded FROM d""")
def display_folding(spark, sf):
    return trace_event(spark, sf).select("event_id", (F.count("*").over(Window.partitionBy("device_id", "stream_id", "start_ns", "end_ns")) > 1).alias("folded"))


@query("CST-06", f"SELECT event_id, round((end_ns - start_ns) / 1000.0, 3) AS self_us, round((end_ns - start_ns) / 1000.0, 3) * CASE WHEN symbol = '{COMMUNICATION}' THEN 1 ELSE 0 END AS comm_us FROM {EV}")
def cost_packets(spark, sf):
    us = S.micros(F.col("end_ns") - F.col("start_ns"))
    return trace_event(spark, sf).select("event_id", us.alias("self_us"), (us * F.when(F.col("symbol") == COMMUNICATION, 1).otherwise(0)).alias("comm_us"))


@query("CTX-06", f"""SELECT a.call_id AS execution_id, count(*) AS calls FROM (SELECT * FROM {RUNTIME_CALL} WHERE api_name = 'api1-URGENT') a JOIN (SELECT * FROM {RUNTIME_CALL} WHERE api_name = 'api2-HIGH') b ON a.process_id = b.process_id AND a.thread_id = b.thread_id AND b.start_ns >= a.start_ns AND b.end_ns <= a.end_ns GROUP BY 1""")
def executions(spark, sf):
    c = runtime_call(spark, sf).select("process_id", "thread_id", "call_id", "start_ns", "end_ns", "api_name")
    met = I.containment_join(c.where("api_name = 'api1-URGENT'"), c.where("api_name = 'api2-HIGH'"), ["process_id", "thread_id"], 24 * I.HOUR)
    return met.groupBy(F.col("call_id").alias("execution_id")).agg(F.count("*").alias("calls"))


@query("SRC-06", f"""WITH c AS (SELECT * FROM {EV} WHERE symbol = '{COMMUNICATION}') SELECT c.event_id AS op_id, count(DISTINCT e.event_id) AS tasks, count(DISTINCT e.stream_id) AS streams FROM c LEFT JOIN {EV} e ON e.device_id = c.device_id AND e.symbol <> '{COMMUNICATION}' AND e.start_ns <= c.end_ns AND e.end_ns >= c.start_ns GROUP BY 1""")
def linked_task_stats(spark, sf):
    e = trace_event(spark, sf).select("device_id", "stream_id", "event_id", "start_ns", "end_ns", "symbol")
    return C.linked_stats(e.where(F.col("symbol") == COMMUNICATION), e.where(F.col("symbol") != COMMUNICATION)).withColumnRenamed("event_id", "op_id")


@query("SRC-05", "SELECT l_partkey, min(p_name) AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def dictionary_lookup(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.min("p_name").alias("name"))
    return table(spark, sf, "lineitem").select("l_partkey").distinct().join(p, "l_partkey", "left")


@query("SRC-16", "SELECT device, model, array_to_string(list_sort(list(DISTINCT stream)), ',') AS streams FROM (SELECT l_suppkey % 4 AS device, l_partkey % 10 AS model, l_linenumber AS stream FROM lineitem) GROUP BY 1, 2")
def capture_streams(spark, sf):
    x = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("device"), (F.col("l_partkey") % 10).alias("model"), F.col("l_linenumber").alias("stream"))
    return x.groupBy("device", "model").agg(F.array_join(F.transform(F.array_sort(F.collect_set("stream")), lambda s: s.cast("string")), ",").alias("streams"))


