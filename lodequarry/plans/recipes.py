"""The catalog: named queries with parameters over the relations, what each yields, and which one can go on from another's result."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Recipe:
    """SQL over relations; a parameter that is null selects all. yields: columns whose values are parameters of other recipes."""

    name: str
    scope: str
    purpose: str
    sql: str
    yields: tuple[str, ...] = ()

    @property
    def parameters(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(re.findall(r":([a-z_]+)", self.sql)))

    @property
    def relations(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(re.findall(r"(?:FROM|JOIN) ([a-z_]+)", self.sql)))


def _where(**columns: str) -> str:
    return " AND ".join(f"(:{p} IS NULL OR {c} = :{p})" for p, c in columns.items())


_ALL = [
    Recipe("scope_catalog", "tree", "nodes that repeat, the largest first", "SELECT node, kind, symbol, repeats, first_pos, last_pos FROM tree WHERE kind <> 'atom' ORDER BY repeats DESC, node", ("node", "symbol")),
    Recipe("scope_occurrences", "tree", "atoms of a symbol", f"SELECT node, parent, symbol, first_pos FROM tree WHERE kind = 'atom' AND {_where(symbol='symbol')} ORDER BY node", ("node",)),
    Recipe("scope_hierarchy", "tree", "children of a node", f"SELECT parent, node, kind, symbol, repeats FROM tree WHERE {_where(node='parent')} ORDER BY parent, first_pos, node", ("node", "symbol")),
    Recipe("scope_members", "tree", "anchors below a node, by position", f"SELECT t.node, a.anchor_id, a.device_id, a.symbol, a.start_ns, a.end_ns FROM tree t JOIN anchor a ON a.device_id = t.device_id AND a.anchor_idx - 1 BETWEEN t.first_pos AND t.last_pos WHERE {_where(node='t.node')} ORDER BY a.device_id, a.anchor_idx", ("anchor_id", "device_id")),
    Recipe("position_population", "tree", "how often each symbol stands at a kind of node", "SELECT kind, symbol, count(*) AS nodes, sum(repeats) AS repeats FROM tree GROUP BY kind, symbol ORDER BY nodes DESC, kind, symbol", ("symbol",)),
    Recipe("runs", "sequence", "runs of one symbol on a device", f"SELECT device_id, run, symbol, first_pos, last_pos, length FROM run WHERE {_where(device_id='device_id', symbol='symbol')} ORDER BY length DESC, device_id, run", ("device_id", "symbol")),
    Recipe("device_cost", "device", "busy time of the devices: union, sum, envelope", f"SELECT * FROM device_cost WHERE {_where(device_id='device_id')} ORDER BY device_id", ("device_id",)),
    Recipe("bubble_hotspots", "bubble", "symbols before which a device is idle longest", "SELECT symbol, count(*) AS bubbles, round(sum(bubble_us), 3) AS total_us, round(avg(bubble_us), 3) AS avg_us, max(bubble_us) AS max_us FROM bubble GROUP BY symbol ORDER BY total_us DESC, symbol", ("symbol",)),
    Recipe("bubbles", "bubble", "single bubbles", f"SELECT anchor_id, device_id, symbol, bubble_us, gap_ns, comm_ns, exec_ns, aux_events FROM bubble WHERE {_where(device_id='device_id', symbol='symbol')} ORDER BY bubble_us DESC, anchor_id", ("anchor_id",)),
    Recipe("bubble_host_context", "bubble", "families of host calls seen in the windows before bubbles", f"SELECT b.symbol, h.api_family, count(DISTINCT b.anchor_id) AS bubbles, count(*) AS calls FROM bubble b JOIN host_activity h ON h.right_anchor_id = b.anchor_id WHERE {_where(symbol='b.symbol')} GROUP BY b.symbol, h.api_family ORDER BY calls DESC, b.symbol, h.api_family", ("symbol",)),
    Recipe("scope_host_windows", "host", "host windows between neighbouring anchors, with their state", f"SELECT * FROM host_interval WHERE {_where(anchor_id='right_anchor_id', device_id='device_id')} ORDER BY device_id, right_anchor_id", ("device_id",)),
    Recipe("host_window_calls", "host", "host calls within the window before an anchor", f"SELECT right_anchor_id AS anchor_id, call_id, api_name, api_family, r_start_ns, r_end_ns FROM host_activity WHERE {_where(anchor_id='right_anchor_id')} ORDER BY right_anchor_id, r_start_ns, call_id", ("call_id",)),
    Recipe("runtime_call_audit", "host", "calls with their relations to device work", f"SELECT c.call_id, c.api_name, c.api_family, r.work_id, r.support_state FROM runtime_call c LEFT JOIN runtime_relation r ON r.call_id = c.call_id WHERE {_where(call_id='c.call_id')} ORDER BY c.call_id, r.work_id"),
    Recipe("runtime_device_relations", "host", "relations by state and cardinality", "SELECT support_state, cardinality, count(*) AS n FROM runtime_relation GROUP BY support_state, cardinality ORDER BY n DESC, support_state, cardinality"),
    Recipe("device_window_events", "event", "events that overlap a window", f"SELECT event_id, device_id, stream_id, symbol, start_ns, end_ns FROM event WHERE {_where(device_id='device_id')} AND (:window_end_ns IS NULL OR start_ns < :window_end_ns) AND (:window_start_ns IS NULL OR end_ns > :window_start_ns) ORDER BY device_id, start_ns, event_id", ("device_id",)),
    Recipe("event_audit", "event", "events with the rule that gave their role", f"SELECT event_id, device_id, symbol, role, rule, support_state FROM event WHERE {_where(event_id='event_id', symbol='symbol')} ORDER BY event_id", ("symbol", "device_id")),
    Recipe("evidence_role_cost_coverage", "event", "events and time by role", "SELECT role, count(*) AS events, sum(end_ns - start_ns) AS total_ns FROM event GROUP BY role ORDER BY total_ns DESC, role"),
    Recipe("evidence_role_unknown", "event", "symbols no rule knows", "SELECT symbol, task_type, count(*) AS events, sum(end_ns - start_ns) AS total_ns FROM event WHERE role = 'unknown_anchor' GROUP BY symbol, task_type ORDER BY events DESC, symbol, task_type", ("symbol",)),
    Recipe("anchor_aux", "anchor", "auxiliary events that an anchor follows", f"SELECT anchor_id, event_id, start_ns, end_ns FROM aux_link WHERE {_where(anchor_id='anchor_id')} ORDER BY anchor_id, start_ns, event_id"),
    Recipe("anchor_cost", "anchor", "an anchor with what its auxiliary events cost", f"SELECT a.anchor_id, a.symbol, a.end_ns - a.start_ns AS self_ns, count(x.event_id) AS aux_events, coalesce(sum(x.end_ns - x.start_ns), 0) AS aux_ns FROM anchor a LEFT JOIN aux_link x ON x.anchor_id = a.anchor_id WHERE {_where(anchor_id='a.anchor_id')} GROUP BY a.anchor_id, a.symbol, a.start_ns, a.end_ns ORDER BY a.anchor_id", ("symbol",)),
    Recipe("symbol_cost", "anchor", "cost of each symbol", "SELECT symbol, count(*) AS n, sum(end_ns - start_ns) AS total_ns, min(end_ns - start_ns) AS min_ns, max(end_ns - start_ns) AS max_ns FROM anchor GROUP BY symbol ORDER BY total_ns DESC, symbol", ("symbol",)),
    Recipe("anchor_timeline", "anchor", "anchors of a device in order", f"SELECT device_id, anchor_idx, anchor_id, symbol, role, start_ns, end_ns FROM anchor WHERE {_where(device_id='device_id')} ORDER BY device_id, anchor_idx", ("anchor_id", "symbol")),
    Recipe("synchronization_actions", "host", "host calls that wait or synchronise", "SELECT call_id, api_name, api_family, start_ns, end_ns FROM runtime_call WHERE api_family IN ('wait', 'synchronize') ORDER BY start_ns, call_id", ("call_id",)),
    Recipe("tree_map", "tree", "the tree in order", "SELECT node, parent, kind, symbol, repeats, first_pos, last_pos FROM tree ORDER BY device_id, first_pos, last_pos DESC, node", ("node",)),
]
RECIPES: dict[str, Recipe] = {r.name: r for r in _ALL}

#: Relations by what a row of them is.
SURFACES: dict[str, str] = {
    "event": "a device event with its role", "anchor": "an event that structure is made of", "aux_link": "an auxiliary event and the anchor it leads to", "device_cost": "a device's busy time",
    "bubble": "idle time before an anchor", "run": "equal neighbouring anchors", "tree": "a node of the folded sequence", "runtime_call": "a host call", "runtime_relation": "a call, a unit of work, or both, with a state",
    "host_interval": "the host window between two anchors", "host_activity": "a call within such a window",
}


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.name, r.scope, r.purpose, ",".join(r.parameters), r.sql) for r in _ALL], "name string, scope string, purpose string, parameters string, sql string")


def parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.name, p) for r in _ALL for p in r.parameters], "recipe string, parameter string")


def coordinates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.name, y) for r in _ALL for y in r.yields], "recipe string, coordinate string")


def surfaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SURFACES.items()), "relation string, row_is string")


def continuations(spark: SparkSession) -> DataFrame:
    """Which recipe can go on from which: all its parameters are yielded, or some of them are."""
    from pyspark.sql import functions as F

    need = parameters(spark).withColumnsRenamed({"recipe": "next", "parameter": "coordinate"})
    many = need.groupBy("next").agg(F.count("*").alias("needed"))
    met = coordinates(spark).join(need, "coordinate").where("recipe <> next").groupBy("recipe", "next").agg(F.count("*").alias("given"))
    return met.join(many, "next").select("recipe", "next", "given", "needed", F.when(F.col("given") == F.col("needed"), "ready").otherwise("partial").alias("readiness"))
