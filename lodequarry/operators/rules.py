"""Rule tables as column expressions: classification by precedence, symbol normalisation with conflicts, and reconciliation of observations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequarry.functions.scalars import task_key


@dataclass(frozen=True)
class RoleRule:
    """A classification rule: the first in order of descending priority, then declaration, whose pattern its field shows."""

    priority: int
    provider: str
    domain: str
    field: str
    match: str
    pattern: str
    role: str
    required: tuple[str, ...]
    defers: bool = False
    rule_id: str = ""

    @property
    def name(self) -> str:
        return self.rule_id or f"{self.provider}.{self.role}.{self.domain}.{self.field}.{self.pattern}"


# The built-in roles. Exact task types per provider and role, then what an operator's text contains.
_EXACT: tuple[tuple[int, str, str, tuple[str, ...]], ...] = (
    (100, "ascend", "auxiliary", ("MODEL_MAINTAINCE", "MODEL_MAINTENANCE")),
    (100, "hygon", "auxiliary", ("HIP_KERNEL_AUX",)),
    (100, "cuda", "auxiliary", ("CUDA_KERNEL_AUX", "CUDA_RUNTIME_AUX", "CUDA_MEMCPY_AUX", "CUDA_SYNC_AUX", "CUDA_EVENT_AUX")),
    (95, "hygon", "anchor", ("HIP_KERNEL",)),
    (95, "cuda", "anchor", ("CUDA_KERNEL", "CUDA_COLLECTIVE_KERNEL")),
)
_CONTROL = ("MODEL_EXECUTE", "CAPTURE_RECORD", "CAPTURE_WAIT", "EVENT_RECORD", "EVENT_WAIT", "MEM_WRITE_VALUE", "MEMCPY", "MEMCPY_ASYNC", "NOTIFY", "NOTIFY_RECORD", "NOTIFY_WAIT", "SDMA", "TASK_TIMEOUT_SET", "WRITE_VALUE")
_SYNC = ("hccl_aiv_sync", "hccl_aic_sync", "aiv_sync", "aic_sync")
_COLLECTIVE = ("nccl", "allreduce", "all_reduce", "allgather", "all_gather", "reducescatter", "reduce_scatter", "broadcast", "alltoall", "all_to_all", "all-to-all", "all2all")
_COMPUTE = ("matmul", "batchmatmul", "gemm", "conv", "flashattention", "fusedinferattention", "pagedattention", "attention", "rmsnorm", "rms_norm", "layernorm", "layer_norm", "swiglu", "siluandmul", "moe", "ffn", "rotary", "rope", "mamba")
_DETAIL = "MatmulAllReduceMc2AicpuKernel_"
_DETAIL_TYPES = ("C_CORE_SQE", "NOTIFY_RECORD_SQE", "NOTIFY_WAIT_SQE", "WRITE_VALUE_SQE", "SDMA_SQE")


def default_rules() -> list[RoleRule]:
    rule = lambda *a, **k: RoleRule(*a, **k)
    out = [rule(200, "ascend", d, "operator", "numbered", _DETAIL, "auxiliary", ("operator", "task_type") if d == "task" else ("operator",)) for d in ("task", "communication_op")]
    out += [rule(p, who, "task", "task_type", "exact", x, role, ("task_type",)) for p, who, role, xs in _EXACT for x in xs]
    out += [rule(90, "ascend", "task", "blob", "contains", x, "auxiliary", ("blob",)) for x in _SYNC]
    out += [rule(85, "ascend", "task", "operator", "exact", "DispatchFFNCombineBF16", "anchor", ("operator",))]
    out += [rule(80, "any", "task", "blob", "contains", x, "anchor", ("blob",)) for x in _COLLECTIVE]
    out += [rule(70, "ascend", "task", "task_type", "exact", "AI_CORE", "transparent", ("task_type",), defers=True)]
    out += [rule(70, who, "task", "task_type", "exact", x, "auxiliary", ("task_type",)) for x in _CONTROL for who in (("ascend", "hygon") if x == "MEMCPY" else ("ascend",))]
    return out + [rule(60, "any", "task", "blob", "contains", x, "anchor", ("blob",)) for x in _COMPUTE]


class RuleError(ValueError):
    """A rule set that contradicts itself."""


def checked(rules: Sequence[RoleRule]) -> list[RoleRule]:
    """The rules in order of precedence; RuleError on repeated names, empty patterns, unknown words, or two equal conditions of one priority and different roles."""
    names: set[str] = set()
    seen: dict[tuple, str] = {}
    for r in rules:
        if r.name in names:
            raise RuleError(f"rule {r.name} is declared twice")
        names.add(r.name)
        if not r.pattern or r.field not in ("task_type", "blob", "operator") or r.match not in ("exact", "contains", "numbered") or r.role not in ("anchor", "auxiliary", "transparent"):
            raise RuleError(f"rule {r.name} is not well formed")
        key = (r.priority, r.provider, r.domain, r.field, r.match, r.pattern.lower())
        if seen.setdefault(key, r.role) != r.role:
            raise RuleError(f"rule {r.name} contradicts another of its precedence")
    return sorted(rules, key=lambda r: -r.priority)


def overridden(base: Sequence[RoleRule], overlay: Sequence[RoleRule]) -> list[RoleRule]:
    """base with the rules of overlay in place of those of the same name, and the others behind them."""
    by_name = {r.name: r for r in overlay}
    return [by_name.pop(r.name, r) for r in base] + list(by_name.values())


def digest(rules: Iterable[object]) -> str:
    """SHA-256 of a rule set in order."""
    return hashlib.sha256("\n".join(map(repr, rules)).encode()).hexdigest()


def _matches(r: RoleRule, domain: str) -> Column:
    value = F.col(f"_{r.field}")
    pattern = r.pattern.upper() if r.field == "task_type" else r.pattern.lower()
    if r.match == "numbered":
        hit = value.rlike(f"^{pattern}[0-9]+(_[0-9]+)*$")
        return hit if domain == "communication_op" else hit & F.col("_task_type").isin(*_DETAIL_TYPES)
    return value == pattern if r.match == "exact" else value.contains(pattern)


def classified(df: DataFrame, rules: Sequence[RoleRule], domain: str = "task", provider: str = "provider", concrete: Column | None = None) -> DataFrame:
    """df (task_type, operator, blob, provider) with role, rule, support_state and missing_rules.

    A matching rule whose required fields are empty is passed over and named in missing_rules; a rule that defers is passed over where the row has an identity of
    its own. No match: role unknown_anchor."""
    concrete = F.lit(False) if concrete is None else concrete
    role = rule = None
    missing: list[Column] = []
    open_ = F.lit(True)
    for r in (r for r in rules if r.domain == domain):
        who = F.lit(True) if r.provider == "any" else (F.col(provider) == r.provider) | (F.col(provider) == "any")
        hit = F.coalesce(who & _matches(r, domain), F.lit(False))
        able = F.lit(True)
        for f in r.required:
            able = able & (F.coalesce(F.col(f), F.lit("")) != "")
        take = hit & able & ~concrete if r.defers else hit & able
        if len(r.required) > 1:  # the matched field itself is never empty
            missing.append(F.when(open_ & hit & ~able, F.lit(r.name)))
            open_ = open_ & ~take
        role = F.when(take, r.role) if role is None else role.when(take, r.role)
        rule = F.when(take, r.name) if rule is None else rule.when(take, r.name)
    lacking = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
    prepared = df.withColumns({"_task_type": task_key(F.col("task_type")), "_blob": F.lower("blob"), "_operator": F.lower("operator")})
    out = prepared.withColumns({"role": role.otherwise("unknown_anchor"), "rule": rule.otherwise("fallback.unknown_observation"), "missing_rules": F.array_join(F.array_sort(lacking), ",")})
    known = F.col("role") != "unknown_anchor"
    state = F.when(known & (F.col("missing_rules") == ""), "supported").when(known, "supported_after_missing_capability").when(F.col("missing_rules") == "", "supported_unknown_first").otherwise("missing_capability")
    return out.withColumn("support_state", state).drop("_task_type", "_blob", "_operator")


@dataclass(frozen=True)
class SymbolRule:
    """Gives a symbol to names; patterns are parted by |."""

    priority: int
    rule_id: str
    match: str
    pattern: str
    symbol: str
    provider: str = "provider-neutral"

    def matches(self, name: Column) -> Column:
        parts = self.pattern.split("|")
        if self.match == "exact":
            return name.isin(*parts)
        if self.match == "contains":
            low, hit = F.lower(name), F.lit(False)
            for p in parts:
                hit = hit | low.contains(p.lower())
            return hit
        if self.match == "numeric_instance":
            return name.rlike("^[0-9]+(_[0-9]+)*$")
        if self.match == "kernel_base":
            return F.coalesce(kernel_base(name), name).isin(*parts)
        raise RuleError(f"rule {self.rule_id} has no match {self.match}")


# The built-in symbols of collectives and of matrix products.
COLLECTIVE_SYMBOLS: tuple[SymbolRule, ...] = (
    SymbolRule(100, "collective.communication.allreduce-alias", "contains", "allreduce|all_reduce", "AllReduce"),
    SymbolRule(95, "ascend.communication.opaque-allreduce-instance", "numeric_instance", "_", "AllReduce", "ascend"),
    SymbolRule(90, "collective.communication.reduce-scatter-alias", "contains", "reducescatter|reduce_scatter", "ReduceScatter"),
    SymbolRule(80, "collective.communication.allgather-alias", "contains", "allgather|all_gather", "AllGather"),
    SymbolRule(70, "collective.communication.broadcast-alias", "contains", "broadcast", "Broadcast"),
)
TASK_SYMBOLS: tuple[SymbolRule, ...] = (
    SymbolRule(100, "ascend.task.aiv-allreduce", "contains", "aiv_all_reduce|aiv_allreduce|aic_all_reduce|aic_allreduce|all_reduce_bfloat16|allreduce_bfloat16", "AIV_AllReduce", "ascend"),
    SymbolRule(90, "ascend.task.matmul-backend-variant", "kernel_base", "MatMulV1|MatMulV2|MatMulV3|BatchMatMulV1|BatchMatMulV2|BatchMatMulV3", "MatMul", "ascend"),
)


def kernel_base(name: Column) -> Column:
    """The operator of a decorated kernel name (a 32-character fingerprint, a lowering mode, or a matrix layout after the first underscore), else null."""
    base, first = F.regexp_extract(name, "^([^_]+)_", 1), F.regexp_extract(name, "^[^_]+_([^_]*)", 1)
    layout = first.isin("ND", "NZ") & base.rlike("^(Batch)?MatMulV[123]$")
    mode = name.contains("_high_performance_") | name.contains("_high_precision_") | name.contains("_optional_")
    return F.when((base != "") & (first.rlike("^[A-Za-z0-9]{32}$") | mode | layout), base)


def normalised(df: DataFrame, rules: Sequence[SymbolRule], name: str, provider: str | None = None) -> DataFrame:
    """df with structural_symbol, outcome (canonicalized, conflict or identity) and symbol_rule.

    Of the rules of the highest priority that match, one alone names the symbol; several are a conflict and keep the observed name, their ids joined by |."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    hits = []
    for r in ordered:
        who = F.lit(True) if provider is None or r.provider == "provider-neutral" else F.lower(F.col(provider)).contains(r.provider)
        hits.append(F.when(F.coalesce(who & r.matches(F.col(name)), F.lit(False)), F.struct(F.lit(r.priority).alias("p"), F.lit(r.rule_id).alias("id"), F.lit(r.symbol).alias("symbol"))))
    found = F.array_compact(F.array(*hits))
    top = F.filter(F.col("_hits"), lambda h: h["p"] == F.element_at(F.col("_hits"), 1)["p"])
    out = df.withColumn("_hits", found).withColumn("_top", F.when(F.size("_hits") > 0, top).otherwise(F.col("_hits")))
    n = F.size("_top")
    return out.withColumns({
        "structural_symbol": F.when(n == 1, F.get("_top", F.lit(0))["symbol"]).otherwise(F.col(name)),
        "outcome": F.when(n == 1, "canonicalized").when(n > 1, "conflict").otherwise("identity"),
        "symbol_rule": F.when(n > 0, F.array_join(F.transform("_top", lambda h: h["id"]), "|")).otherwise("fallback.identity"),
    }).drop("_hits", "_top")


def reconciled(df: DataFrame, identity: Sequence[str], is_generic: Column, is_concrete: Column, least_contained: float = 0.99) -> DataFrame:
    """Observations (start_ns, end_ns) with group sizes and status: reconciled where one generic and one concrete observation share an identity and the concrete one
    lies within the generic one for at least this share; conflict if it does not; ambiguous if there are several of a kind; independent otherwise."""
    w = Window.partitionBy(*identity)
    g, c = F.coalesce(is_generic, F.lit(False)), F.coalesce(is_concrete, F.lit(False))
    out = df.withColumns({"generic_n": F.sum(g.cast("int")).over(w), "concrete_n": F.sum(c.cast("int")).over(w)})
    pick = lambda flag, col: F.max(F.when(flag, F.col(col))).over(w)
    gs, ge, cs, ce = pick(g, "start_ns"), pick(g, "end_ns"), pick(c, "start_ns"), pick(c, "end_ns")
    share = F.greatest(F.lit(0), F.least(ge, ce) - F.greatest(gs, cs)) / (ce - cs)
    one = (F.col("generic_n") == 1) & (F.col("concrete_n") == 1)
    out = out.withColumn("contained", F.when(one & (ce > cs), share))
    status = F.when(one & (F.col("contained") >= least_contained), "reconciled").when(one, "conflict").when((F.col("generic_n") > 0) & (F.col("concrete_n") > 0), "ambiguous").otherwise("independent")
    return out.withColumn("status", F.when(g | c, status).otherwise("independent"))


def overlaid(base: Mapping[str, Mapping], overlay: Mapping[str, Mapping]) -> tuple[dict[str, dict], str]:
    """Rules by id with those of the overlay in their place, and the digest of the whole."""
    out = {k: dict(v) for k, v in base.items()} | {k: dict(v) for k, v in overlay.items()}
    return out, digest(sorted((k, sorted(v.items())) for k, v in out.items()))


def with_id(rule: RoleRule, rule_id: str) -> RoleRule:
    return replace(rule, rule_id=rule_id)
