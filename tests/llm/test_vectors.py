import numpy as np

from lodequarry.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, shard string"


def cluster(rng, n, spread, d=16):
    base = rng.normal(size=d)
    return base + rng.normal(size=(n, d)) * spread


def brute(rows, least=0.93):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) for r in rows]
    links = np.zeros((n, n), bool)
    unit = [np.array(np.float32(r[1]), float) / np.linalg.norm(np.array(np.float32(r[1]), float)) if o else None for r, o in zip(rows, ok)]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a, b] = links[b, a] = True
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in np.flatnonzero(links[a]):
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
    return links.sum(1), label


def test_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(120, 16)), cluster(rng, 25, 0.12), cluster(rng, 10, 0.05)])
    rows = [(k, [float(x) for x in x_], k % 2, "clash") for k, x_ in enumerate(v)]
    rows += [(1000 + k, [1.0] * 16, 5, "clash") for k in range(6)]
    rows += [(2000, None, 1, "c"), (2001, [0.0] * 16, 1, "c"), (2002, [float("nan")] * 16, 1, "c"), (2003, [None] * 16, 1, "c"), (2004, [1.0] * 16, None, "c"), (2005, [], 1, "c"), (2006, [float("inf")] * 16, 5, "c"), (2007, [1.0] * 3, 5, "c"), (2008, [2.0] * 3, 5, "c"), (2009, [1.0] * 5, 5, "c")]
    n, label = brute(rows)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(min(got[r[0]]["n_links"], n[k]) for k, r in enumerate(rows))
    assert found >= 0.98 * n.sum() and all(got[r[0]]["n_links"] <= n[k] for k, r in enumerate(rows))
    assert all(got[r[0]]["component_id"] == rows[label[k]][0] for k, r in enumerate(rows))
    assert all(got[r[0]]["kept"] == (got[r[0]]["component_id"] == r[0]) for r in rows)
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splitting_keeps_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CAP", 150)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(400, 16)), *(cluster(rng, 12, 0.1) for _ in range(12))])
    rows = [(k, [float(x) for x in x_], 0, "") for k, x_ in enumerate(v)]
    _, nodes = vectors.nodes_of(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    assert vectors.shards(nodes, 2).select("shard").distinct().count() > 1
    found = vectors.link(nodes, 0.93, overlap=3)
    assert vectors.recall(found, nodes, 0.93) >= 0.9


def test_pruned_graph_is_searchable():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(500, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    edges = vectors.neighbours(unit, 24, 48, 1.2, 1)
    assert all(len(set(e[e >= 0])) == (e >= 0).sum() for e in edges)
    found = vectors.search(unit, edges, np.arange(500), 0.6, 48)
    true = unit @ unit.T >= 0.6
    np.fill_diagonal(true, False)
    assert not (found & ~true).any() and (found & true).sum() >= 0.95 * true.sum()


def hot_and_small():
    rng = np.random.default_rng(7)
    v = np.concatenate([cluster(rng, 500, 0.03), rng.normal(size=(300, 16)), *(cluster(rng, 3, 0.03) for _ in range(100))])
    return [(k, [float(x) for x in x_], 0, "") for k, x_ in enumerate(v)]


def test_links_outside_a_hot_group_are_found():
    unit = np.array([r[1] for r in hot_and_small()])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = unit @ unit.T >= 0.93
    np.fill_diagonal(true, False)
    edges = vectors.neighbours(unit, 32, 64, 1.2, 1)
    assert ((edges[:500] >= 500).sum(1) > 0).mean() > 0.9
    found = vectors.search(unit, edges, np.arange(len(unit)), 0.93, 48)
    assert not (found & ~true).any() and (found & true)[500:].sum() >= 0.98 * true[500:].sum() and found[:500].sum() >= 0.98 * true[:500].sum()


def test_a_large_group_that_lies_together_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CAP", 100)
    monkeypatch.setattr(vectors, "BLOCK", 60)
    rows = hot_and_small()
    n, label = brute(rows)
    report = {}
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), report=report).collect()}
    assert min(report["recall"]) > 0.5 and sum(got[k]["n_links"] for k in range(len(rows))) >= 0.98 * n.sum()
    assert all(got[k]["n_links"] <= n[k] for k in range(len(rows))) and sum(got[k]["component_id"] == label[k] for k in range(len(rows))) >= 0.98 * len(rows)


def test_audit_sees_small_groups_and_all_pairs_follow(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 300)
    rows = hot_and_small()
    n, label = brute(rows)
    _, nodes = vectors.nodes_of(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    whole = vectors.exact(nodes, 0.93)
    lost = whole.where("node = -1").union(vectors.links_of(whole, nodes).selectExpr("node", "node as to", "if(links > 100, links, 0L) as links"))
    assert vectors.recall(whole, nodes, 0.93) == 1 and vectors.recall(lost, nodes, 0.93) < 0.5
    monkeypatch.setattr(vectors, "link", lambda *a, **k: lost)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k]["n_links"] == n[k] and got[k]["component_id"] == label[k] for k in range(len(rows)))
