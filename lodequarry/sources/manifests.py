"""Rule manifests: TSV with a header, or the flat YAML that rule files use; stacked by replace, extend or override."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from pathlib import Path

from lodequarry.operators.rules import RoleRule, RuleError


@dataclass
class Manifest:
    """The rows of a rule file, what it says about itself, and the SHA-256 of its bytes."""

    rows: list[dict[str, str]]
    metadata: dict[str, str] = field(default_factory=dict)
    sha256: str = ""


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def parse(text: str, kind: str) -> Manifest:
    """kind: tsv or yaml. RuleError on rows that do not fit the header, and on YAML beyond mappings of scalars and one list of them."""
    rows: list[dict[str, str]] = []
    meta: dict[str, str] = {}
    if kind == "tsv":
        lines = [x for x in text.splitlines() if x.strip()]
        meta = dict(m.groups() for x in lines if (m := re.match(r"#\s*(\w+):\s*(.*)", x)))
        body = [x.split("\t") for x in lines if not x.startswith("#")]
        for r in body[1:]:
            if len(r) != len(body[0]):
                raise RuleError(f"a row has {len(r)} fields, the header {len(body[0])}")
            rows.append(dict(zip(body[0], r)))
    else:
        at: dict[str, str] | None = meta
        for n, line in enumerate(text.splitlines(), 1):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            m = re.fullmatch(r"(\s*)(- )?([A-Za-z_][\w.-]*):(?:\s+(.*))?", line)
            if not m:
                raise RuleError(f"line {n} is not understood")
            if m[2]:
                at = {}
                rows.append(at)
            elif not m[1]:
                at = meta
            if m[4] is not None and m[4].strip():
                at[m[3]] = _scalar(m[4])
    return Manifest(rows, meta, hashlib.sha256(text.encode()).hexdigest())


def load(path: str) -> Manifest:
    return parse(Path(path).read_text(), "tsv" if path.endswith(".tsv") else "yaml")


def role_rules(manifest: Manifest) -> list[RoleRule]:
    """Classification rules of a manifest."""
    match = {"exact": "exact", "contains": "contains"}
    return [
        RoleRule(int(r["priority"]), r.get("provider_scope", "any"), r.get("source_domain", "task"), r["field"], match.get(r["match"], "numbered"), r["pattern"], r["role"], tuple(x for x in r.get("required_fields", "").split(",") if x), r.get("concrete_identity_behavior") == "defer_to_identity_rules", r["rule_id"])
        for r in manifest.rows
    ]


def stacked(base: list[dict[str, str]], overlay: list[dict[str, str]], how: str, key: str = "rule_id") -> list[dict[str, str]]:
    """replace: the overlay alone; extend: both, RuleError if they share an id; override: the overlay's rows in place of those of their ids."""
    if how == "replace":
        return list(overlay)
    ids = {r[key]: r for r in overlay}
    if how == "extend":
        if both := ids.keys() & {r[key] for r in base}:
            raise RuleError(f"declared twice: {sorted(both)}")
        return [*base, *overlay]
    if how == "override":
        return [ids.pop(r[key], r) for r in base] + list(ids.values())
    raise RuleError(f"no way of stacking is called {how}")
