"""Near-duplicate vectors: a robust-pruned flat graph over overlapping shards, searched greedily from medoids and then by range.

Equal vectors of a label are one node with a multiplicity; vectors of different lengths never meet. Labels with too many nodes are split by centres that lie apart, each node going to its nearest
centres; the nearest is its home. Every shard builds a graph; the adjacency lists of a node from all its shards are united, and where an edge near the range leaves a shard, its end
is taken along with its own list, so that the search of a shard's home nodes walks the united graph beyond the shard. Groups that lie together and are too large
for one task are compared in blocks instead. Links are counted where both ends have the same home, and written down only where they cross. The result is audited against
brute force by size of group; where no try passes the audit, all nodes of a label are compared in blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequarry.llm import shared
from lodequarry.llm.components import components

CAP = 4096  # nodes of a shard that is not split further
FAN = 128  # centres that a split makes at most
SAMPLE = 2048  # nodes that centres are chosen from
LONG = 8  # slots of a node that are kept for random edges, a quarter of all at most
BLOCK = 1024  # nodes of a block of the exact comparison
MARGIN = 0.1  # edges whose cosine is at most so much below the range are followed out of a shard


def nodes_of(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their node (null for vectors that link with nothing), and the nodes: node, label, vector, copies, first (smallest id)."""
    v = F.col(vector_column).cast("array<double>")
    fine = F.col(label_column).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    for seed in range(8):
        h = lambda s: F.xxhash64(F.lit(s), F.col(label_column).cast("string"), v)
        ok = F.coalesce(fine, F.lit(False))
        rows = vectors.select(F.col(id_column).alias("vec_id"), F.concat_ws("/", F.size(v), F.col(label_column).cast("string")).alias("label"), v.alias("vector"), F.when(ok, h(seed)).alias("node"), F.when(ok, h(seed + 100)).alias("check"))
        nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.min("check").alias("x"), F.max("check").alias("y"))
        nodes = shared.staged(nodes, "vector-nodes")
        if nodes.where("x != y").isEmpty():
            break
    return rows.select("vec_id", "node"), nodes.drop("x", "y")


def _unit(column) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def leaders(unit: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Positions of vectors none of which is nearer than `apart` (cosine) to one before it; the first `most` of them."""
    out: list[int] = []
    near = np.zeros(len(unit), bool)
    for k in range(len(unit)):
        if not near[k]:
            out.append(k)
            if len(out) == most:
                break
            near |= unit @ unit[k] >= apart
    return np.array(out)


def _centres(pdf):
    import pandas as pd

    pdf = pdf.sort_values("node")
    unit = _unit(pdf["vector"])
    want = int(np.clip(-(-int(pdf["size"].iloc[0]) * 2 // CAP), 2, FAN))
    chosen = unit[leaders(unit, want, 0.75)]
    return pd.DataFrame({"shard": pdf["shard"].iloc[0], "centres": [chosen.ravel()], "n": len(chosen)})


def _assign(overlap: int):
    import pandas as pd

    def run(members, centres):
        if not len(members) or not len(centres):
            return pd.DataFrame({"node": [], "shard": [], "home": []}).astype({"node": "int64", "shard": "str", "home": "bool"})
        unit = _unit(members["vector"])
        c = centres["centres"].iloc[0].reshape(int(centres["n"].iloc[0]), -1)
        s = unit @ c.T
        k = min(overlap, len(c))
        near = np.argsort(-s, axis=1, kind="stable")[:, :k]
        stem = centres["shard"].iloc[0]
        home = np.repeat(members["home"].to_numpy(), k) & (np.tile(np.arange(k), len(members)) == 0)
        return pd.DataFrame({"node": np.repeat(members["node"].to_numpy(), k), "shard": [f"{stem}/{x}" for x in near.ravel()], "home": home})

    return run


def shards(nodes: DataFrame, overlap: int, depth: int = 4) -> DataFrame:
    """node, shard, home, whole: every node once or more, once at home. Shards over CAP nodes are split up to `depth` times; whole tells those still over it, as all their nodes lie close together."""
    members = nodes.select("node", F.col("label").alias("shard"), F.lit(True).alias("home"))
    done = None
    for _ in range(depth):
        sizes = members.groupBy("shard").agg(F.count("*").alias("size"))
        big = shared.staged(sizes.where(F.col("size") > CAP), "big-shards")
        if big.isEmpty():
            break
        kept = members.join(big, "shard", "left_anti").select("node", "shard", "home")
        done = kept if done is None else done.union(kept)
        split = members.join(big, "shard").join(nodes.select("node", "vector"), "node")
        sampled = split.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < F.lit(SAMPLE * float(1 << 30)) / F.col("size"))
        centres = shared.staged(sampled.groupBy("shard").applyInPandas(_centres, "shard string, centres array<double>, n int"), "centres")
        whole = centres.where("n < 2").select("shard")  # all close together
        done = done.union(members.join(whole, "shard").select("node", "shard", "home"))
        salted = split.join(whole, "shard", "left_anti").withColumn("salt", F.pmod(F.xxhash64(F.lit(4), "node"), F.ceil(F.col("size") / CAP)).cast("int"))
        by_salt = centres.where("n >= 2").join(big, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / CAP).cast("int") - 1)))
        keys = lambda df, *c: df.select("shard", "salt", *c).groupBy("shard", "salt")
        members = keys(salted, "node", "home", "vector").cogroup(keys(by_salt, "centres", "n")).applyInPandas(_assign(overlap), "node long, shard string, home boolean")
        members = shared.staged(members, "shard-members")
    members = members if done is None else done.union(members)
    whole = members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > CAP).select("shard", F.lit(True).alias("whole"))
    return shared.staged(members.join(F.broadcast(whole), "shard", "left").select("node", "shard", "home", F.coalesce("whole", F.lit(False)).alias("whole")), "shard-members")


def neighbours(unit: np.ndarray, degree: int, width: int, alpha: float, seed: int) -> np.ndarray:
    """Out-edges of each vector by robust pruning of its nearest vectors and some random ones, and up to LONG random ones that pruning cannot displace; -1 fills up."""
    n = len(unit)
    rng = np.random.default_rng(seed)
    width, short = min(width, n - 1), degree - min(LONG, degree // 4)
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        s = unit[rows] @ unit.T
        s[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-s, width - 1, axis=1)[:, :width]
        far_off = rng.integers(0, n, (len(rows), 16))
        pool = np.concatenate([near, far_off], axis=1)
        ps = np.take_along_axis(s, pool, 1)
        order = np.argsort(-ps, axis=1, kind="stable")
        pool, ps = np.take_along_axis(pool, order, 1), np.take_along_axis(ps, order, 1)
        open_ = ps > -2
        open_[:, 1:] &= pool[:, 1:] != pool[:, :-1]
        far = np.sqrt(np.maximum(0, 2 - 2 * ps))
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ijd,ikd->ijk", unit[pool], unit[pool])))
        got = np.zeros(len(rows), np.int64)
        for k in range(pool.shape[1]):
            take = open_[:, k] & (got < short)
            r = np.flatnonzero(take)
            out[rows[r], got[r]] = pool[r, k]
            got[r] += 1
            open_[r] &= alpha * between[r, k] > far[r]
            open_[r, k] = False
        for to in far_off.T:
            r = np.flatnonzero((got < degree) & (to != rows) & (out[rows] != to[:, None]).all(1))
            out[rows[r], got[r]] = to[r]
            got[r] += 1
    return out


def _build(degree: int, width: int, alpha: float):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("node")
        node = pdf["node"].to_numpy()
        unit = _unit(pdf["vector"])
        edges = neighbours(unit, degree, width, alpha, len(node))
        a, k = np.nonzero(edges >= 0)
        b = edges[a, k]
        return pd.DataFrame({"node": node[a], "to": node[b], "s": np.einsum("ij,ij->i", unit[a], unit[b])})

    return run


def search(unit: np.ndarray, edges: np.ndarray, queries: np.ndarray, least: float, beam: int) -> np.ndarray:
    """For each query (a position), a row of booleans over all vectors: those found with a cosine of `least` or more, itself left out.

    A greedy search with a beam runs from the medoid and the query itself until every query's beam is expanded; then all found in range are expanded, and what they find in range, until nothing is new."""
    n, q = len(unit), len(queries)
    found, visited = np.zeros((q, n), bool), np.zeros((q, n), bool)
    start = int(np.argmax(unit @ unit.mean(0)))
    rows = np.arange(q)
    beam_at = np.full((q, beam), -1, np.int64)
    beam_s = np.full((q, beam), -3.0)
    beam_at[:, 0] = start
    beam_s[:, 0] = np.einsum("ij,j->i", unit[queries], unit[start])
    visited[rows, start] = True
    found[rows, start] = beam_s[:, 0] >= least
    other = np.flatnonzero(queries != start)
    if beam > 1:
        beam_at[other, 1], beam_s[other, 1] = queries[other], 1.0
    visited[rows, queries] = found[rows, queries] = True
    opened = np.zeros((q, beam), bool)
    active = rows
    while len(active):
        waiting = np.where(opened[active] | (beam_at[active] < 0), -4.0, beam_s[active])
        best = waiting.argmax(1)
        on = waiting[np.arange(len(active)), best] > -4
        active, best = active[on], best[on]
        if not len(active):
            break
        opened[active, best] = True
        nb = edges[beam_at[active, best]]
        fresh = (nb >= 0) & ~visited[active[:, None], np.maximum(nb, 0)]
        r, c = np.nonzero(fresh)
        to = nb[r, c]
        visited[active[r], to] = True
        s = np.full(nb.shape, -3.0)
        s[r, c] = np.einsum("ij,ij->i", unit[queries[active[r]]], unit[to])
        hit = s[r, c] >= least
        found[active[r[hit]], to[hit]] = True
        all_at = np.concatenate([beam_at[active], np.where(fresh, nb, -1)], 1)
        all_s = np.concatenate([beam_s[active], s], 1)
        all_o = np.concatenate([opened[active], np.zeros(nb.shape, bool)], 1)
        keep = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        beam_at[active], beam_s[active], opened[active] = (np.take_along_axis(x, keep, 1) for x in (all_at, all_s, all_o))
    r, to = np.nonzero(found)
    while len(r):  # the range grows from all that was found in it
        new_r, new_to = [], []
        for at in range(0, len(r), 1 << 15):
            nb = edges[to[at : at + (1 << 15)]]
            row = np.repeat(r[at : at + (1 << 15)], nb.shape[1])
            nb = nb.ravel()
            ok = nb >= 0
            row, nb = row[ok], nb[ok]
            ok = ~visited[row, nb]
            key = np.unique(row[ok] * n + nb[ok])
            row, nb = key // n, key % n
            visited[row, nb] = True
            hit = np.einsum("ij,ij->i", unit[queries[row]], unit[nb]) >= least
            found[row[hit], nb[hit]] = True
            new_r.append(row[hit])
            new_to.append(nb[hit])
        r, to = np.concatenate(new_r), np.concatenate(new_to)
    found[rows, queries] = False
    return found


def _forest(found: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each by a symmetric boolean matrix."""
    n = len(found)
    label = np.full(n, -1, np.int64)
    for k in range(n):
        if label[k] < 0:
            label[k] = k
            front = np.array([k])
            while len(front):
                nxt = found[front].any(0) & (label < 0)
                front = np.flatnonzero(nxt)
                label[front] = k
    return label


def _searcher(least: float, beam: int):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("node")
        node, home = pdf["node"].to_numpy(), pdf["home"].to_numpy()
        unit = _unit(pdf["vector"])
        lists = [np.asarray(x if x is not None else [], np.int64) for x in pdf["to"]]
        size = np.array([len(x) for x in lists])
        flat = np.concatenate(lists) if len(lists) else np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        at[node[at] != flat] = -1  # ends that are not in this shard
        edges = np.full((len(node), max(1, size.max(initial=1))), -1, np.int64)
        row = np.repeat(np.arange(len(node)), size)
        edges[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = at
        at_home = np.flatnonzero(home)
        found = search(unit, edges, at_home, least, beam)
        inner = found[:, at_home]
        inner |= inner.T
        copies = pdf["copies"].to_numpy()
        links = inner @ copies[at_home]
        root = _forest(inner)
        r, c = np.nonzero(found & ~home[None, :])
        own = pd.DataFrame({"node": node[at_home], "to": node[at_home][root], "links": links})
        cross = pd.DataFrame({"node": node[at_home][r], "to": node[c], "links": np.full(len(r), -1)})
        return pd.concat([own, cross], ignore_index=True).astype({"node": "int64", "to": "int64", "links": "int64"})

    return run


def link(nodes: DataFrame, least: float, degree: int = 32, width: int = 64, alpha: float = 1.2, beam: int = 48, overlap: int = 2) -> DataFrame:
    """node, to, links: a row per node with the links to nodes of the same home and the smallest of its home that they reach, and a row for each link across homes (links -1)."""
    members = shards(nodes, overlap)
    vectors = nodes.select("node", "vector", "copies")
    some = members.where("not whole").select("shard", "node", "home")
    edges = some.join(vectors, "node").groupBy("shard").applyInPandas(_build(degree, width, alpha), "node long, to long, s double")
    edges = shared.staged(edges, "vector-edges")
    united = edges.groupBy("node").agg(F.collect_set("to").alias("to"))
    beyond = some.join(edges.where(F.col("s") >= least - MARGIN), "node").select("shard", F.col("to").alias("node")).distinct()
    beyond = beyond.join(some, ["shard", "node"], "left_anti").select("shard", "node", F.lit(False).alias("home"))
    ready = some.union(beyond).join(vectors, "node").join(united, "node", "left").select("shard", "node", "home", "vector", "copies", "to")
    found = ready.groupBy("shard").applyInPandas(_searcher(least, beam), "node long, to long, links long")
    return shared.staged(found.union(_compared(members.where("whole"), vectors, least)), "vector-links")


def _auditor(told, least: float):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for label, part in pdf.groupby("label"):
                if label in told.value:
                    node, unit = told.value[label]
                    s = _unit(part["vector"]) @ unit.T
                    k, q = np.nonzero((s >= least) & (part["node"].to_numpy()[:, None] != node[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(node[q]), pa.array(part["copies"].to_numpy()[k])], ["node", "n"])

    return run


def links_of(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and links: other vectors linked to each node, copies counted, links across homes seen from both ends."""
    cross = found.where("links < 0").select("node", "to")
    both = cross.union(cross.select("to", "node")).distinct()
    across = both.join(nodes.select(F.col("node").alias("to"), "copies"), "to").groupBy("node").agg(F.sum("copies").alias("more"))
    own = found.where("links >= 0").groupBy("node").agg(F.sum("links").alias("links"))
    return own.join(across, "node", "left").select("node", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"))


def _blocks(least: float):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("node")
        node, copies, home, unit = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["home"].to_numpy(), _unit(pdf["vector"])
        part, a, b = pdf["part"].to_numpy(), pdf["a"].iloc[0], pdf["b"].iloc[0]
        met = unit @ unit.T >= least
        met &= part[:, None] != part[None, :] if a != b else ~np.eye(len(node), dtype=bool)
        inner = met[np.ix_(home, home)]
        own = pd.DataFrame({"node": node[home], "to": node[home][_forest(inner)], "links": inner @ copies[home]})
        r, c = np.nonzero(met & home[:, None] & ~home[None, :])
        cross = pd.DataFrame({"node": node[r], "to": node[c], "links": np.full(len(r), -1)})
        return pd.concat([own, cross], ignore_index=True).astype({"node": "int64", "to": "int64", "links": "int64"})

    return run


def _compared(members: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """node, to, links as of `link`, from all pairs of a shard, in blocks: a row per home node and pair of blocks, with the links in it and the smallest node of it that they reach. A task holds two blocks."""
    parts = members.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int"))
    dealt = dealt.join(vectors, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = dealt.select("shard", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "node", "home", "vector", "copies")
    return pairs.groupBy("shard", "a", "b").applyInPandas(_blocks(least), "node long, to long, links long")


def exact(nodes: DataFrame, least: float) -> DataFrame:
    """node, to, links as of `link`, from all pairs of a label. Quadratic in a label."""
    members = nodes.select("node", F.col("label").alias("shard"), F.lit(True).alias("home"))
    return shared.staged(_compared(members, nodes.select("node", "vector", "copies"), least), "vector-pairs")


def recall(found: DataFrame, nodes: DataFrame, least: float, queries: int = 800) -> float:
    """The share of a node's links that were found: the mean over nodes with about as many links, and of these means the least.

    Brute force over all nodes for some, taken by hash: half from those with no link found, the others evenly from each class of links found. A node counts for
    the nodes of its class that it stands for. Classes by links (powers of two) with under ten nodes taken are one. `queries` is about what tasks are told."""
    spark = nodes.sparkSession
    links = links_of(found, nodes).withColumn("found_class", F.floor(F.log2(F.col("links") + 1)).cast("int"))
    sizes = {r["found_class"]: r["n"] for r in links.groupBy("found_class").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return 1.0
    others = max(1, len(sizes) - (0 in sizes))
    rate = F.lit(0.0)
    for k, n in sizes.items():
        rate = F.when(F.col("found_class") == k, min(1.0, queries / 2 / (1 if k == 0 else others) / n)).otherwise(rate)
    some = links.where(F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(1 << 30)) < rate * float(1 << 30)).join(nodes, "node").select("node", "label", "vector", "links", "found_class").toPandas()
    if not len(some):
        return 1.0
    told = spark.sparkContext.broadcast({label: (part["node"].to_numpy(), _unit(part["vector"])) for label, part in some.groupby("label")})
    true = nodes.select("node", "label", "vector", "copies").mapInArrow(_auditor(told, least), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toPandas()
    taken = some.groupby("found_class").size().to_dict()
    some = some.merge(true, on="node")  # nodes without any link have nothing to find
    if not len(some):
        return 1.0
    n, got = some["n"].to_numpy(), np.minimum(some["n"], some["links"]).to_numpy()
    stands = some["found_class"].map(sizes).to_numpy() / some["found_class"].map(taken).to_numpy()
    group = np.floor(np.log2(n + 1)).astype(int)
    group[np.bincount(group)[group] < 10] = -1
    return float(min(np.average((got / n)[group == g], weights=stands[group == g]) for g in np.unique(group)))


def near_duplicates(vectors: DataFrame, least: float = 0.93, wanted: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", report: dict | None = None) -> DataFrame:
    """A row per row of vectors: vec_id, n_links, component_id (smallest id reachable by links) and kept (vec_id = component_id).

    Two vectors of one label that is not null link if the cosine, in double precision, is at least `least`. Vectors that are null, empty, zero or hold
    null or non-finite components have no links and are components of their own. Equal vectors link with one another. Links are those that the graph search finds; if an
    audit against brute force finds fewer than `wanted` of them for groups of any size, beam, degree and overlap are doubled, twice at most; then all pairs are compared. Rows with one id are
    vectors each of their own. A null id is smaller than none. Vectors of different lengths have no cosine and do not link, whatever their label. report, if given, gets the recall that the audit
    measured, by try, and whether all pairs were compared after that. Other columns are left aside; an empty table gives no rows."""
    rows, nodes = nodes_of(vectors, id_column, vector_column, label_column)
    for wide in (1, 2, 4):
        found = link(nodes, least, degree=32 * wide, width=64 * wide, beam=48 * wide, overlap=1 + wide)
        got = recall(found, nodes, least)
        if report is not None:
            report.setdefault("recall", []).append(got)
        if got >= wanted:
            break
    else:
        if report is not None:
            report["exact"] = True
        found = exact(nodes, least)
    joined = shared.staged(components(found.where("node != to"), "node", "to"), "vector-components")
    by_node = nodes.join(joined, "node", "left").select("node", "copies", "first", F.coalesce("component", "node").alias("component"))
    named = by_node.groupBy("component").agg(F.min("first").alias("component_id"))
    told = by_node.join(named, "component").join(links_of(found, nodes), "node").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.join(told, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
