"""The facade: analyse a profile into relations, query them with SQL or by recipe, and export them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequarry.functions import scalars as S
from lodequarry.operators import intervals, relations, rules, sequence, structure
from lodequarry.plans import recipes, sinks
from lodequarry.sources import manifests, profiles


class TooManyRows(ValueError):
    """A result has more rows than were asked for."""


@dataclass
class Timeline:
    """Relations by name; each is also a temporary view."""

    spark: SparkSession
    relations: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, df in self.relations.items():
            df.createOrReplaceTempView(name)

    def sql(self, text: str, args: Mapping[str, object] | None = None, limit: int | None = 1000) -> list[dict]:
        """Rows of a query with :name parameters; TooManyRows beyond the limit. Only queries are let through."""
        if not text.lstrip().lower().startswith(("select", "with", "values", "from")):
            raise ValueError("only queries may be run")
        df = self.spark.sql(text, args=dict(args or {}))
        rows = df.limit(limit + 1).collect() if limit is not None else df.collect()
        if limit is not None and len(rows) > limit:
            raise TooManyRows(f"over {limit} rows")
        return [r.asDict() for r in rows]

    def recipe(self, name: str, limit: int | None = 1000, **args: object) -> list[dict]:
        """Rows of a recipe of the catalog; parameters that are not given select all."""
        r = recipes.RECIPES[name]
        if strange := set(args) - set(r.parameters):
            raise ValueError(f"{name} has no parameters {sorted(strange)}")
        return self.sql(r.sql, {p: args.get(p) for p in r.parameters}, limit)

    def save(self, out: str) -> None:
        sinks.publish(self.relations, out)

    def export_perfetto(self, out: str, compress: bool = False) -> None:
        sinks.write_perfetto(self.relations["event"], out, compress)


def derived(task: DataFrame, communication: DataFrame | None = None, calls: DataFrame | None = None, provider: str = "ascend", role_rules: list[rules.RoleRule] | None = None) -> dict[str, DataFrame]:
    """The relations made of tasks, collectives and host calls: event, anchor, aux_link, device_cost, bubble, run, tree, runtime_call, runtime_relation, host_interval, host_activity."""
    have = set(task.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    symbol = F.coalesce(text("op_type"), text("op_name"), text("comm_name"), text("task_type"), F.lit("unnamed"))
    said = task.withColumns({"symbol": symbol, "operator": F.coalesce(text("op_name"), F.lit("")), "blob": F.lower(F.concat_ws(" ", text("op_name"), text("op_type"), text("task_type"))), "provider": F.lit(provider), "task_type": F.coalesce(text("task_type"), F.lit(""))})
    event = rules.classified(said, rules.checked(role_rules or rules.default_rules())).select("event_id", "device_id", "stream_id", "start_ns", "end_ns", "connection_id", "symbol", "task_type", "operator", "blob", "role", "rule", "support_state")
    if communication is not None:
        ops = communication.select((-F.col("event_id")).alias("event_id"), "device_id", F.lit(None).cast("long").alias("stream_id"), "start_ns", "end_ns", "connection_id", F.coalesce(*[c for c in ("op_type", "op_name") if c in communication.columns]).alias("symbol"))
        ops = rules.normalised(ops, rules.COLLECTIVE_SYMBOLS, "symbol").withColumn("symbol", F.col("structural_symbol")).drop("structural_symbol", "outcome", "symbol_rule")
        covered = intervals.overlap_join(event.where("connection_id is not null"), ops.select("device_id", "connection_id", "start_ns", "end_ns"), ["device_id", "connection_id"], closed=True).select("event_id").distinct().withColumn("covered", F.lit(True))
        event = event.join(covered, "event_id", "left").withColumn("role", F.when(F.col("covered"), "represented").otherwise(F.col("role"))).drop("covered")
        event = event.unionByName(ops.withColumns({"task_type": F.lit("communication"), "operator": F.col("symbol"), "blob": F.lower("symbol"), "role": F.lit("comm"), "rule": F.lit("communication_op"), "support_state": F.lit("supported")}))
    order = ["start_ns", "end_ns", "stream_id", "symbol", "event_id"]
    w = Window.partitionBy("device_id").orderBy(*order)
    anchor = event.where(F.col("role").isin("anchor", "comm", "unknown_anchor")).withColumn("anchor_idx", F.row_number().over(w)).withColumn("anchor_id", F.col("event_id"))
    aux = intervals.following(event.where("role = 'auxiliary'").select("device_id", "event_id", "start_ns", "end_ns"), anchor.select("device_id", "anchor_id", "start_ns"), ["device_id"], "end_ns", "start_ns", "anchor_id").withColumnRenamed("following", "anchor_id")
    gap = intervals.gaps(anchor, ["device_id"], "anchor_id")
    low = F.lower("blob")
    cost = intervals.gap_costs(gap, event.where("role = 'auxiliary'"), ["device_id"], "anchor_id", F.col("role") == "comm", ~low.contains("wait"))
    bubble = cost.withColumn("bubble_us", S.micros(F.col("idle_ns"))).where("bubble_us > 0").join(anchor.select("anchor_id", "anchor_idx", "symbol"), "anchor_id")
    runs = sequence.runs(anchor, ["device_id"], order, "symbol")
    out = {"event": event, "anchor": anchor, "aux_link": aux, "device_cost": intervals.busy(event, ["device_id"]), "bubble": bubble, "run": runs, "tree": structure.folded_runs(runs, ["device_id"])}
    if calls is not None:
        keyed = calls.withColumns({"correlation_id": F.col("connection_id"), "process_id": F.shiftright("thread_id", 32) if "thread_id" in calls.columns else F.lit(None).cast("long"), "thread_id": F.col("thread_id") if "thread_id" in calls.columns else F.lit(None).cast("long")})
        out["runtime_call"] = keyed.withColumns({"api_family": S.api_family(F.col("api_name")), "api_layer": S.api_layer(F.col("api_name"))})
        work = event.select(F.col("event_id").alias("work_id"), F.col("connection_id").alias("correlation_id"))
        out["runtime_relation"] = relations.correlated(keyed, work)
        linked = out["runtime_relation"].where("call_id is not null and work_id is not null").select(F.col("work_id").alias("anchor_id"), "call_id").join(keyed.select("call_id", F.col("start_ns").alias("call_start"), F.col("end_ns").alias("call_end"), "process_id", "thread_id"), "call_id")
        host = relations.host_intervals(anchor.join(linked, "anchor_id", "left"), ["device_id"], order)
        out["host_interval"] = host
        window = host.where("support_state = 'supported_ordered'").select(F.lit(1).alias("clock"), "left_anchor_id", "right_anchor_id", F.col("host_start_ns").alias("start_ns"), F.col("host_end_ns").alias("end_ns"), "scope_policy", "process_id", "thread_id")
        seen = intervals.overlap_join(window, out["runtime_call"].select(F.lit(1).alias("clock"), "call_id", "api_name", "api_family", "start_ns", "end_ns", "process_id", "thread_id"), ["clock"], bin_ns=10_000_000)
        out["host_activity"] = seen.where(relations.in_scope()).drop("clock")
    return out


def analyze(spark: SparkSession, source: str, output: str | None = None, rules_config: str | None = None, how: str = "extend") -> Timeline:
    """Relations of every profile at or below a path (their rows carry `source`); written to `output` and read back if it is given."""
    found = profiles.discover(source)
    if not found:
        raise ValueError(f"{source} holds no profile")
    role_rules = rules.default_rules()
    if rules_config:
        more = manifests.role_rules(manifests.load(rules_config))
        role_rules = more if how == "replace" else rules.overridden(role_rules, more)
    out: dict[str, DataFrame] = {}
    split = sorted({p.rsplit("/", 1)[0] for p, k in found if k == "split"})
    for path, kind in [*[(p, k) for p, k in found if k != "split"], *[(p, "ascend") for p in split]]:
        got = profiles.load(spark, path)
        for name, df in derived(got["task"], got.get("communication"), got.get("runtime_call"), kind, role_rules).items():
            df = df.withColumn("source", F.lit(path))
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    if output:
        sinks.publish(out, output, tuple(p for p, _ in found))
        out = {name: spark.read.parquet(f"{output}/{name}") for name in out}
    return Timeline(spark, out)


def bundled_rules(name: str) -> list:
    """The built-in rules called classification, task_symbols or collective_symbols."""
    return {"classification": rules.default_rules(), "task_symbols": list(rules.TASK_SYMBOLS), "collective_symbols": list(rules.COLLECTIVE_SYMBOLS)}[name]
