"""Sharding by histogram sort: exact bytes below candidate key boundaries, refined until the splitters are close enough, then one exchange.

The key of a row is the hash of its text, then its id, so that equal texts stand together: a group of copies is cut only where it
is itself too heavy for a boundary beside it. All of it is DataFrame operations; the driver sees counts of key cells, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodequarry.llm import shared

DIGIT = 10  # bits of the key that one refinement looks at
HASH_BITS = 60


@dataclass(frozen=True)
class Cell:
    """Rows whose key begins with these digits: level and digits name it, in key order."""

    path: tuple[int, ...]
    rows: int
    size: int
    lowest: int
    highest: int


def _digits(key: str, id_key: str, id_bits: int) -> list[Column]:
    """The key's digits from the most significant: of the hash, then of the id above the smallest id."""
    ids = -(-id_bits // DIGIT)
    return [F.shiftrightunsigned(F.col(key), HASH_BITS - DIGIT * (k + 1)).bitwiseAND((1 << DIGIT) - 1) for k in range(HASH_BITS // DIGIT)] + [
        F.shiftrightunsigned(F.col(id_key), DIGIT * (ids - k - 1)).bitwiseAND((1 << DIGIT) - 1) for k in range(ids)
    ]


def _name(levels: list[Column], opened: list[dict[tuple[int, ...], int]]) -> Column:
    """The name of a row's cell: digits joined by dots, as deep as its cells were opened.

    opened[d] maps each opened path of d digits to the level of the digit that its children show (levels may be skipped where all rows agree)."""

    def below(depth: int, said: Column) -> Column:
        if depth == len(opened) or not opened[depth]:
            return said
        by_level: dict[int, list[str]] = {}
        for path, level in opened[depth].items():
            by_level.setdefault(level, []).append(".".join(map(str, path)))
        out = None
        for level, names in by_level.items():
            deeper = below(depth + 1, F.concat(said, F.lit("."), levels[level].cast("string")))
            out = F.when(said.isin(names), deeper) if out is None else out.when(said.isin(names), deeper)
        return out.otherwise(said)

    return below(1, levels[0].cast("string"))


def cells(keys: DataFrame, shards: int, tolerance: float, id_bits: int) -> tuple[list[Cell], list[dict[tuple[int, ...], int]]]:
    """Key cells in order, opened until every splitter lies within tolerance * (bytes of a shard) of a cell's edge and no cell
    holds over 1/512 of the rows; both end at single keys. keys: key, id_key, size. An opened cell has 1024 children at most, and at most
    512 + shards cells are opened at a depth, so the driver's share is bounded."""
    levels = _digits("key", "id_key", id_bits)
    hash_levels = HASH_BITS // DIGIT
    opened: list[dict[tuple[int, ...], int]] = [{(): 0}]
    found: dict[tuple[int, ...], Cell] = {}
    level_of: dict[tuple[int, ...], int] = {}
    depth = 0
    while opened[depth]:
        part = keys if not depth else keys.where(_name(levels, opened[:depth]).isin([".".join(map(str, p)) for p in opened[depth]]))
        got = part.groupBy(_name(levels, opened).alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for r in got:
            path = tuple(map(int, r["cell"].split(".")))
            found[path] = Cell(path, r["n"], r["size"], r["a"], r["b"])
            level_of[path] = opened[depth][path[:-1]]
        for path in opened[depth]:
            found.pop(path, None)
        ordered = sorted(found.values(), key=lambda c: c.path)
        rows, size = sum(c.rows for c in ordered), sum(c.size for c in ordered)
        nxt: dict[tuple[int, ...], int] = {}
        at = 0
        for c in ordered:
            near = min(range(1, shards), key=lambda k: abs(at + c.size / 2 - k * size / shards), default=None)
            cut = near is not None and any(at < k * size / shards < at + c.size and min(k * size / shards - at, at + c.size - k * size / shards) > tolerance * size / shards for k in (near - 1, near, near + 1) if 0 < k < shards)
            if len(c.path) == depth + 1 and c.rows > 1 and (cut or c.rows > max(256, rows // 512)):
                level = level_of[c.path] + 1
                if c.lowest == c.highest:
                    level = max(level, hash_levels)
                if level < len(levels):
                    nxt[c.path] = level
            at += c.size
        opened.append(nxt)
        depth += 1
    return sorted(found.values(), key=lambda c: c.path), opened


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns of docs, with size, shard and slot: shards of nearly equal bytes (UTF-8 bytes of the text, null: none, plus 1).

    slot counts the rows of a shard from 0 without gaps, in key order (hash of the text, id). Rows alike in text and id are
    one key and never parted by a boundary; a null id sorts below all others. Copies stand together: a boundary inside a group
    of copies is chosen only if no boundary beside it is within the tolerance. Columns named size, shard, slot or lq_* in docs are replaced.
    An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot")
    text = F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.withColumns({"lq_key": F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS), "size": F.octet_length(text).cast("long") + 1})
    keys = shared.staged(keyed.select(F.col("lq_key").alias("key"), F.col(id_column).cast("long").alias("id"), "size"), "shard-keys")
    low, high = keys.agg(F.min("id"), F.max("id")).first()
    low = 0 if low is None else low
    id_bits = max(1, (0 if high is None else high - low + 1).bit_length())
    id_key = lambda c: F.coalesce(c - F.lit(low) + 1, F.lit(0))
    if id_bits > 62:  # ids that span the whole long range: their order by halves
        id_bits, id_key = 64, lambda c: F.coalesce(c, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    keys = keys.select("key", id_key(F.col("id")).alias("id_key"), "size")
    ordered, opened = cells(keys, shards, tolerance, id_bits)
    total = sum(c.size for c in ordered)
    edges = [0]
    for c in ordered:
        edges.append(edges[-1] + c.size)
    bounds = [min(range(len(edges)), key=lambda i: abs(edges[i] - k * total / shards)) for k in range(1, shards)]
    plan, slot, last = [], 0, 0
    for i, c in enumerate(ordered):
        s = sum(b <= i for b in bounds)
        slot = slot if s == last else 0
        plan.append((".".join(map(str, c.path)), s, slot))
        slot, last = slot + c.rows, s
    schema = T.StructType([T.StructField("lq_cell", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("lq_base", T.LongType())])
    of_cell = F.broadcast(spark.createDataFrame(plan, schema))  # a row per cell
    keyed = keyed.withColumn("lq_id", id_key(F.col(id_column).cast("long")))
    keyed = keyed.withColumn("lq_cell", _name(_digits("lq_key", "lq_id", id_bits), opened))
    order = Window.partitionBy("lq_cell").orderBy("lq_key", "lq_id")
    placed = keyed.withColumn("lq_rank", F.row_number().over(order)).join(of_cell, "lq_cell", "left")
    return placed.select(*docs.columns, "size", "shard", (F.col("lq_base") + F.col("lq_rank") - 1).alias("slot"))
