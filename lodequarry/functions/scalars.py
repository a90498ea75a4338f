"""Scalar functions with the null, division and rounding rules that trace relations rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_least(*cols: Column | str) -> Column:
    """The least, but null if any is null (Spark's own skips nulls)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    some = cs[0].isNull()
    for c in cs[1:]:
        some = some | c.isNull()
    return F.when(~some, F.least(*cs))


def null_greatest(*cols: Column | str) -> Column:
    """The greatest, but null if any is null."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    some = cs[0].isNull()
    for c in cs[1:]:
        some = some | c.isNull()
    return F.when(~some, F.greatest(*cs))


def micros(ns: Column) -> Column:
    """Nanoseconds as microseconds, to the nanosecond."""
    return F.round(ns / 1000.0, 3)


def ppm(part: Column, whole: Column) -> Column:
    """floor(part * 1e6 / whole) in integers; 0 of nothing; null where part exceeds whole. Exact for values up to 10**31."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.when(whole == 0, F.lit(0)).when(part <= whole, F.floor(wide(part) * F.lit(1_000_000).cast("decimal(7,0)") / wide(whole)).cast("long"))


def task_key(name: Column) -> Column:
    """Upper case, anything but letters and digits as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "_"), F.lit("_"))


# Families of host calls by what their lower-case names contain, in order of precedence.
FAMILIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("wait", ("wait",)),
    ("synchronize", ("synchronize",)),
    ("query", ("query",)),
    ("event_record", ("eventrecord", "recordevent")),
    ("event_lifecycle", ("eventcreate", "createevent", "eventdestroy", "destroyevent")),
    ("graph_launch", ("graphlaunch", "aclmdlriexecuteasync")),
    ("launch", ("launch",)),
    ("memory", ("memcpy", "memset", "inplacecopy")),
    ("graph_control", ("capture", "graph")),
)
# How public names begin.
PUBLIC = ("acl", "cuda", "hip")


def api_family(name: Column) -> Column:
    low, out = F.lower(F.coalesce(name, F.lit(""))), None
    for family, parts in FAMILIES:
        has = low.contains(parts[0])
        for p in parts[1:]:
            has = has | low.contains(p)
        out = F.when(has, family) if out is None else out.when(has, family)
    return out.otherwise("other")


def api_layer(name: Column) -> Column:
    return F.when(F.lower(F.coalesce(name, F.lit(""))).rlike("^(" + "|".join(PUBLIC) + ")"), "public").otherwise("provider_internal_or_unknown")


def quartile(values: Column, k: int) -> Column:
    """The element at ((n - 1) * k + 2) div 4 of a sorted array."""
    return F.element_at(values, (F.floor(((F.size(values) - 1) * k + 2) / 4) + 1).cast("int"))


def middle(values: Column) -> Column:
    """The median of a sorted array of longs; of an even number, the mean of the two in the middle, rounded down."""
    n = F.size(values)
    lo, hi = F.element_at(values, F.floor((n + 1) / 2).cast("int")), F.element_at(values, F.floor(n / 2 + 1).cast("int"))
    return F.floor((lo + hi) / 2).cast("long")


def nearest_rank(values: Column, p: float) -> Column:
    """The value of rank ceil(p * n) of a sorted array."""
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(F.size(values) * p)).cast("int"))


# Marks that keep a text from being published: within its letters and digits, as all of them, and anywhere in it.
PRIVATE_LETTERS = ("authorization", "bearer", "apikey", "password", "secret", "accesstoken", "refreshtoken", "privatekey", "rawprompt", "rawoutput", "hiddenreasoning", "chainofthought", "systemprompt", "traceback")
PRIVATE_WHOLE = ("token", "prompt", "output", "reasoning")
PRIVATE_PARTS = ("sk-", "://", "http:", "https:", "file:", "javascript:", "data:", "ssh:", "s3:", "gs:", "../", "..\\", "\\", "<", ">", "/etc/", "/home/", "/tmp/", "/proc/", "~/")


def public_text(text: Column) -> Column:
    """Whether a text shows no credential, prompt, path or address, nor control characters other than tab and newline."""
    low = F.lower(text)
    letters = F.regexp_replace(low, "[^a-z0-9]", "")
    bad = text.rlike("[\\x00-\\x08\\x0b-\\x1f\\x7f]") | letters.isin(*PRIVATE_WHOLE) | low.rlike("^[a-z]:/") | (low.startswith("eyj") & low.contains("."))
    for mark in PRIVATE_LETTERS:
        bad = bad | letters.contains(mark)
    for mark in PRIVATE_PARTS:
        bad = bad | low.contains(mark)
    return ~bad


def label_ok(text: Column) -> Column:
    """1 to 128 letters, digits and _.:- that may be published."""
    return text.rlike("^[A-Za-z0-9_.:-]{1,128}$") & public_text(text)


def hex_id_ok(text: Column, digits: int) -> Column:
    """Lower-case hex of this length, not all zeros."""
    return text.rlike(f"^[0-9a-f]{{{digits}}}$") & ~text.rlike("^0+$")
