"""Scheduler context and inference logs: records parsed from JSON, typed states, spans, dependencies and costs of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequarry.functions.scalars import null_greatest, null_least
from lodequarry.operators.intervals import busy, overlap_counts, overlap_join

STEP_SCHEMA = "schema string, type string, run_id string, producer_id string, step_id string, ordinal long, total_scheduled_tokens long, requests array<struct<request_id:string,scheduled_tokens:long,scheduled_token_start:long,prompt_tokens:long>>, cache struct<observation_phase:string,free_blocks:long,pool_blocks:long>, finished_request_ids array<string>, preempted_request_ids array<string>, resumed_request_ids array<string>, execution_id string, marker string, worker_rank long, phase string, status string, marker_state string, written_records long, dropped_records long"


class ContextError(ValueError):
    """Records that contradict one another."""


def records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of JSON as typed records beside their text; well_formed is false for text that is no JSON object or repeats a key."""
    ok = F.try_parse_json(column).isNotNull() & F.col(column).rlike(r"^\s*\{")
    return lines.select(F.col(column).alias("raw_json"), ok.alias("well_formed"), F.from_json(column, STEP_SCHEMA).alias("r")).select("raw_json", "well_formed", "r.*")


def capture_state(recs: DataFrame) -> DataFrame:
    """By run and producer: closed (a summary without losses), dropped (one with losses) or unclosed, and the records seen."""
    by = recs.where("well_formed").groupBy("run_id", "producer_id").agg(F.count("*").alias("records"), F.count_if(F.col("type") == "summary").alias("summaries"), F.max("dropped_records").alias("dropped"))
    return by.select("run_id", "producer_id", "records", F.when(F.col("summaries") == 0, "unclosed").when(F.coalesce("dropped", F.lit(0)) > 0, "dropped").otherwise("closed").alias("capture_state"))


def steps(recs: DataFrame) -> DataFrame:
    """Steps, with whether the tokens of their requests add up."""
    said = F.aggregate(F.coalesce(F.col("requests"), F.array().cast("array<struct<request_id:string,scheduled_tokens:long,scheduled_token_start:long,prompt_tokens:long>>")), F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["scheduled_tokens"], F.lit(0)))
    return recs.where("type = 'step'").select("run_id", "producer_id", "step_id", "ordinal", "total_scheduled_tokens", F.coalesce(F.size("requests"), F.lit(0)).cast("long").alias("scheduled_requests"), (said == F.col("total_scheduled_tokens")).alias("adds_up"), "cache", "requests", "finished_request_ids", "preempted_request_ids", "resumed_request_ids")


def requests(step: DataFrame) -> DataFrame:
    """A row per step and request, with the phase its scheduled tokens belong to.

    Of the tokens, those before the end of the prompt are prompt tokens; without both offsets the phase is unknown."""
    rows = step.select("run_id", "step_id", "ordinal", F.explode("requests").alias("q")).select("run_id", "step_id", "ordinal", "q.*")
    known = (F.col("scheduled_token_start") >= 0) & (F.col("prompt_tokens") >= 0)
    prompt = F.when(known, null_least(F.col("scheduled_tokens"), null_greatest(F.lit(0), F.col("prompt_tokens") - F.col("scheduled_token_start"))))
    return rows.withColumn("prompt_part", prompt).withColumn("generated_part", F.col("scheduled_tokens") - F.col("prompt_part")).withColumn("phase", phase("prompt_part", "scheduled_tokens"))


def phase(prompt: str, tokens: str) -> Column:
    p, t = F.col(prompt), F.col(tokens)
    return F.when(p.isNull(), "unknown").when(t == 0, "no_tokens").when(p == t, "prefill").when(p == 0, "decode").otherwise("mixed")


def step_kinds(step: DataFrame, request: DataFrame) -> DataFrame:
    """Steps with a kind from the tokens of all their requests, and a shape from their counts."""
    by = request.groupBy("run_id", "step_id").agg(F.count("prompt_part").alias("classified"), F.sum("prompt_part").alias("p"), F.sum("generated_part").alias("g"))
    met = step.join(by, ["run_id", "step_id"], "left")
    n, t = F.col("scheduled_requests"), F.col("total_scheduled_tokens")
    kind = F.when((n == 0) & (t == 0), "empty_decision").when(F.coalesce("classified", F.lit(0)) != n, "unknown").when((F.col("p") > 0) & (F.col("g") == 0), "prefill").when((F.col("p") == 0) & (F.col("g") > 0), "decode").when((F.col("p") > 0) & (F.col("g") > 0), "mixed").otherwise("unknown")
    shape = F.when((n == 0) & (t == 0), "empty_decision").when((n == 1) & (t == 1), "single_request_single_token").when(n == 1, "single_request_other_tokens").otherwise("multiple_requests")
    return met.select("run_id", "step_id", "ordinal", kind.alias("step_kind"), shape.alias("step_shape"))


def observations(step: DataFrame) -> DataFrame:
    """Requests as scheduled, and as reported finished, preempted or resumed: run, step, ordinal, request, observation."""
    base = ["run_id", "step_id", "ordinal"]
    out = step.select(*base, F.explode(F.transform("requests", lambda q: q["request_id"])).alias("request_id"), F.lit("scheduled").alias("observation"))
    for kind in ("finished", "preempted", "resumed"):
        out = out.unionByName(step.select(*base, F.explode(f"{kind}_request_ids").alias("request_id"), F.lit(f"{kind}_observed").alias("observation")))
    return out


def bound(items: DataFrame, markers: DataFrame, key: str, marker_id: str, captured: Column) -> DataFrame:
    """Items with the marker of their key and a state: missing (no key), unavailable (nothing captured), not_found, ambiguous or supported."""
    by = markers.groupBy(key).agg(F.count("*").alias("_n"), F.min(marker_id).alias("_one"))
    met = items.join(by, key, "left")
    n = F.coalesce("_n", F.lit(0))
    state = F.when(F.col(key).isNull(), "missing").when(~captured, "unavailable").when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("supported")
    return met.withColumns({"marker": F.when(n == 1, F.col("_one")), "marker_state": state}).drop("_n", "_one")


def unique_by(df: DataFrame, keys: Sequence[str], of: Sequence[str]) -> DataFrame:
    """The rows of groups in which `of` has one value only."""
    one = df.groupBy(*keys).agg(F.count_distinct(F.struct(*of)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(one, list(keys), "left_semi")


def step_costs(step: DataFrame, work: DataFrame, keys: Sequence[str] = ("run_id", "step_id")) -> DataFrame:
    """Steps with the summed, united and enveloped time of their distinct work per device; null, not zero, where no work is linked."""
    once = work.dropDuplicates([*keys, "device_id", "work_id"])
    cost = busy(once, [*keys, "device_id"]).withColumnsRenamed({"intervals": "linked_work"})
    return step.select(*keys).join(cost, list(keys), "left").withColumn("linked_work", F.coalesce("linked_work", F.lit(0)))


def linked_stats(ops: DataFrame, work: DataFrame) -> DataFrame:
    """By event_id of ops, the distinct events (tasks) and streams of work on its device that overlap or touch it.

    Counted stream by stream without the pairs. Only where an id repeats or is null, or an interval is reversed, are the pairs met, as those cannot be counted so."""
    cols = ["device_id", "stream_id", "event_id", "start_ns", "end_ns"]
    plain = lambda df: df.withColumn("_plain", (F.count("*").over(Window.partitionBy("event_id")) == 1) & F.col("event_id").isNotNull() & (F.col("end_ns") >= F.col("start_ns")) & F.col("stream_id").isNotNull())
    ops, work = plain(ops.select(*cols)), plain(work.select(*cols))
    odd = ops.groupBy("event_id").agg(F.bool_and("_plain").alias("_plain"))
    a, b = ops.where("_plain"), work.where("_plain")
    streams = b.select("device_id", "stream_id").distinct()
    asked = a.select("device_id", "event_id", "start_ns", "end_ns").join(F.broadcast(streams), "device_id")  # a row per device and stream is broadcast
    counted = overlap_counts(asked, b, ["device_id", "stream_id"], "event_id").where("n > 0").select("event_id", "stream_id", F.col("n").alias("tasks"))
    met = overlap_join(a, work.where("not _plain"), ["device_id"], closed=True).unionByName(overlap_join(ops.where("not _plain"), work, ["device_id"], closed=True))
    seen = met.groupBy("event_id", F.col("r_stream_id").alias("stream_id"), "r_event_id").agg(F.lit(1).alias("_"))
    rest = seen.groupBy("event_id", "stream_id").agg(F.lit(0).cast("long").alias("tasks"))
    ids = seen.groupBy("event_id").agg(F.count_distinct("r_event_id").alias("more"))
    by = counted.unionByName(rest).groupBy("event_id").agg(F.sum("tasks").alias("tasks"), F.count_distinct("stream_id").alias("streams")).join(ids, "event_id", "left")
    return odd.select("event_id").join(by, "event_id", "left").select("event_id", (F.coalesce("tasks", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("tasks"), F.coalesce("streams", F.lit(0)).alias("streams"))


def spans(events: DataFrame) -> DataFrame:
    """Spans from their start, end and other events (trace_id, span_id, event_id, event_type, producer_id, clock_id, sequence, at_ns, parent_span_id, name, kind, status).

    A span without a start or an end is open or missing_start; its times are of what was seen. A duration needs one producer and one clock."""
    own = events.where(~F.col("event_type").isin("metrics", "trace_end"))
    pick = lambda kind, c: F.max_by(F.when(F.col("event_type") == kind, F.col(c)), F.when(F.col("event_type") == kind, F.lit(1)))
    fields = ("producer_id", "clock_id", "at_ns", "status")
    by = own.groupBy("trace_id", "span_id").agg(
        F.bool_or(F.col("event_type") == "span_start").alias("has_start"), F.bool_or(F.col("event_type") == "span_end").alias("has_end"),
        *(pick("span_start", c).alias(f"s_{c}") for c in (*fields, "parent_span_id", "name", "kind")), *(pick("span_end", c).alias(f"e_{c}") for c in fields),
        F.min_by(F.struct("producer_id", "clock_id", "at_ns"), "sequence").alias("f"),
    )
    first = lambda c: F.coalesce(f"s_{c}", f"e_{c}", f"f.{c}")
    same = (F.col("s_producer_id") == F.col("e_producer_id")) & (F.col("s_clock_id") == F.col("e_clock_id"))
    return by.select(
        "trace_id", "span_id", F.col("s_parent_span_id").alias("parent_span_id"), F.coalesce("s_name", F.lit("unobserved")).alias("name"), F.coalesce("s_kind", F.lit("step")).alias("kind"),
        F.when(~F.col("has_start"), "missing_start").when(~F.col("has_end"), "open").otherwise(F.col("e_status")).alias("status"), "has_start", "has_end",
        first("producer_id").alias("producer_id"), first("clock_id").alias("clock_id"), F.coalesce("s_at_ns", "f.at_ns").alias("start_ns"), F.coalesce("e_at_ns", "f.at_ns").alias("end_ns"),
        F.when(same, F.col("e_at_ns") - F.col("s_at_ns")).alias("duration_ns"),
    )


def trace_states(span: DataFrame, events: DataFrame) -> DataFrame:
    """Traces that are live_or_incomplete, finished_with_incomplete_spans or finished_observed."""
    ends = events.groupBy("trace_id").agg(F.max(F.when(F.col("event_type") == "trace_end", F.col("span_id"))).alias("root"), F.count_if(F.col("event_type") == "trace_end").alias("ends"))
    whole = span.groupBy("trace_id").agg(F.bool_and(F.col("has_start") & F.col("has_end")).alias("whole"))
    roots = span.where("has_start and has_end").select("trace_id", F.col("span_id").alias("root"), F.lit(True).alias("root_ok"))
    met = ends.join(whole, "trace_id", "left").join(roots, ["trace_id", "root"], "left")
    fine = F.coalesce("whole", F.lit(True)) & F.coalesce("root_ok", F.lit(False))
    return met.select("trace_id", F.when(F.col("ends") == 0, "live_or_incomplete").when(~fine, "finished_with_incomplete_spans").otherwise("finished_observed").alias("state"))


def dependencies(links: DataFrame, span: DataFrame) -> DataFrame:
    """Links (trace_id, span_id, source) with a timing state: incomplete, cross_clock or observed_same_clock."""
    s = span.select("trace_id", "span_id", F.col("has_end").alias("s_end"), F.col("producer_id").alias("s_p"), F.col("clock_id").alias("s_c"))
    p = span.select("trace_id", F.col("span_id").alias("source"), (F.col("has_start") & F.col("has_end")).alias("p_ok"), F.col("producer_id").alias("p_p"), F.col("clock_id").alias("p_c"))
    met = links.join(s, ["trace_id", "span_id"]).join(p, ["trace_id", "source"], "left")
    state = F.when(~(F.coalesce("p_ok", F.lit(False)) & F.col("s_end")), "incomplete").when((F.col("s_p") != F.col("p_p")) | (F.col("s_c") != F.col("p_c")), "cross_clock").otherwise("observed_same_clock")
    return met.select("trace_id", "span_id", "source", state.alias("timing_state"))


def longest_paths(span: DataFrame, links: DataFrame) -> DataFrame:
    """By span, its depth below its root and the longest sum of durations along links that lead to it, itself included.

    One task orders one trace. ValueError if parents or links have a cycle."""
    import pandas as pd

    joined = span.select("trace_id", "span_id", "parent_span_id", F.coalesce("duration_ns", F.lit(0)).alias("duration_ns")).join(links.groupBy("trace_id", "span_id").agg(F.collect_list("source").alias("sources")), ["trace_id", "span_id"], "left")

    def measure(pdf):
        parent = dict(zip(pdf["span_id"], pdf["parent_span_id"]))
        cost = dict(zip(pdf["span_id"], pdf["duration_ns"]))
        before = {s: [x for x in (src if src is not None else []) if x in parent] for s, src in zip(pdf["span_id"], pdf["sources"])}
        depth: dict = {}
        for s in parent:
            chain, at = [], s
            while at in parent and at not in depth:
                if at in chain:
                    raise ValueError("the parents of a trace have a cycle")
                chain.append(at)
                at = parent[at]
            d = depth.get(at, -1)
            for x in reversed(chain):
                d += 1
                depth[x] = d
        open_, done = {s: len(b) for s, b in before.items()}, {}
        after: dict = {}
        for s, b in before.items():
            for x in b:
                after.setdefault(x, []).append(s)
        ready = [s for s, n in open_.items() if not n]
        while ready:
            s = ready.pop()
            done[s] = cost[s] + max((done[x] for x in before[s]), default=0)
            for x in after.get(s, ()):
                open_[x] -= 1
                if not open_[x]:
                    ready.append(x)
        if len(done) < len(parent):
            raise ValueError("the links of a trace have a cycle")
        return pd.DataFrame({"trace_id": pdf["trace_id"].iloc[0], "span_id": list(parent), "depth": [depth[s] for s in parent], "path_ns": [int(done[s]) for s in parent]})

    kinds = {f.name: f.dataType.simpleString() for f in span.schema}
    return joined.groupBy("trace_id").applyInPandas(measure, f"trace_id {kinds['trace_id']}, span_id {kinds['span_id']}, depth long, path_ns long")


def with_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    return df.withColumn(f"previous_{column}", F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))
