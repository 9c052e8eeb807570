"""Graph operators against plain Python on random graphs, on one machine's arrays and as distributed loops."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.operators import aggregates, centrality, changes, components, lookups, traverse
from callweave.operators.kernels import Graph


def random_edges(seed, nodes, count):
    r = random.Random(seed)
    return [(r.randrange(nodes), r.randrange(nodes)) for _ in range(count)]


def adjacency(edges):
    out = {}
    for a, b in edges:
        if a is not None:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
    return out


def levels(adj, seed, depth):
    dist, queue = {seed: 0}, deque([seed])
    while queue:
        v = queue.popleft()
        if dist[v] < depth:
            for w in adj.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
    del dist[seed]
    return dist


def frame(spark, edges, resolution="exact"):
    rows = [(a, b, "calls", resolution, "f", 1, k) for k, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, "src long, dst long, kind string, resolution string, file string, line int, ref_id long")


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_reachability(spark, local):
    edges = [*random_edges(1, 40, 60), (None, 3), (None, 5)]
    adj = adjacency(edges)
    back = adjacency([(b, a) for a, b in edges if a is not None])
    df = frame(spark, edges)
    for direction, graph, depth in (("callees", adj, 3), ("callers", back, 6)):
        got = {(r["seed"], r["id"]): r["depth"] for r in traverse.reachable(df, ids(spark, 0, 1, 2, 99), direction, depth, local).collect()}
        assert got == {(s, n): d for s in (0, 1, 2, 99) for n, d in levels(graph, s, depth).items()}


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_shortest_paths(spark, local):
    edges = random_edges(2, 30, 45)
    adj, df = adjacency(edges), frame(spark, edges)
    for sources, targets in (((0, 1), (7, 9)), ((3,), (3, 4)), ((5,), (777,))):
        got = traverse.shortest_path(df, ids(spark, *sources), ids(spark, *targets), local_edges=local)
        best = min((0 if s == t else levels(adj, s, 99).get(t, 999) for s in sources for t in targets), default=999)
        assert (got is None) == (best == 999)
        if got:
            assert len(got) == best + 1 and got[0] in sources and got[-1] in targets and all(b in adj[a] for a, b in zip(got, got[1:]))


def test_equal_paths_give_the_smallest(spark):
    df = frame(spark, [(1, 9), (1, 5), (9, 20), (5, 20), (5, 21)])
    for local in (1_000_000, 0):
        assert traverse.shortest_path(df, ids(spark, 1), ids(spark, 20), local_edges=local) == [1, 5, 20]


def components_by_hand(edges):
    adj = adjacency(edges)
    reach = {v: {v, *levels(adj, v, 10**6)} for v in adj}
    return {v: min(w for w in reach[v] if v in reach[w]) for v in adj}


@pytest.mark.parametrize(("seed", "local"), [(3, 1_000_000), (4, 1_000_000), (5, 0)])
def test_strong_components(spark, seed, local):
    edges = random_edges(seed, 25, 32)
    got = {r["id"]: r["component"] for r in components.strong_components(frame(spark, edges), local).collect()}
    assert got == components_by_hand(edges)


def test_cycles_leave_out_inferred_and_hook_edges(spark):
    df = frame(spark, [(1, 2), (2, 1), (2, 2), (7, 7)]).union(frame(spark, [(3, 4)], "ambiguous")).union(frame(spark, [(4, 3)], "ambiguous")).union(frame(spark, [(5, 6), (6, 5)], "inferred"))
    assert [(r["size"], list(r["members"])) for r in components.cycles(df).collect()] == [(2, [1, 2]), (2, [3, 4]), (1, [2]), (1, [7])]
    assert components.cycles(df, exclude=()).count() == 5


def test_searches_over_many_partitions(spark):
    """Grouping must hold with several shuffle partitions and adaptive execution too."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        edges = random_edges(9, 40, 90)
        adj = adjacency(edges)
        seeds = spark.createDataFrame([(s,) for s in adj], "id long")
        want = {(s, n): d for s in adj for n, d in levels(adj, s, 4).items()}
        for limit in (10**6, 0):
            got = {(r["seed"], r["id"]): r["depth"] for r in traverse.reachable(frame(spark, edges), seeds, "callees", 4, local_edges=limit).collect()}
            assert got == want
        a, b = ({r["id"]: r["component"] for r in components.strong_components(frame(spark, edges), local_edges=n).collect()} for n in (10**6, 0))
        assert a == b
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def betweenness_by_hand(edges):
    adj = adjacency(edges)
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist = {s: 0, **levels(adj, s, 10**6)}
        paths = {s: 1}
        for v in sorted(dist, key=dist.get):
            for w in adj[v]:
                if dist.get(w) == dist[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
        for t in dist:
            if t == s:
                continue
            through = {t: 1}  # paths from a node to t
            for v in sorted(dist, key=dist.get, reverse=True):
                for w in adj[v]:
                    if dist.get(w) == dist[v] + 1 and w in through:
                        through[v] = through.get(v, 0) + through[w]
            for v in dist:
                if v not in (s, t) and v in through:
                    score[v] += paths[v] * through[v] / paths[t]
    return score


def test_betweenness(spark):
    edges = random_edges(6, 30, 60)
    got = {r["id"]: r["score"] for r in centrality.betweenness(frame(spark, edges)).collect()}
    want = betweenness_by_hand(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert centrality.betweenness(frame(spark, edges), max_nodes=5) is None
    assert centrality.betweenness(frame(spark, [])).count() == 0
    with pytest.raises(centrality.TooLarge):
        centrality.betweenness(frame(spark, edges), local_edges=10)
    # many sources at once, with several paths of equal length
    edges = random_edges(7, 60, 400)
    got = {r["id"]: r["score"] for r in centrality.betweenness(frame(spark, edges)).collect()}
    want = betweenness_by_hand(edges)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_betweenness_searches_from_branching_nodes_only(spark):
    from callweave.operators.kernels import Forest, Graph

    rng = random.Random(8)
    for n, extra in ((40, 3), (25, 0), (30, 8)):
        edges = sorted({(v, rng.randrange(n)) for v in range(n)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(extra)})
        a, b = np.array(edges).T
        assert len(Forest(Graph(a, b)).roots) <= extra + 6
        got = {r["id"]: r["score"] for r in centrality.betweenness(frame(spark, edges)).collect()}
        want = betweenness_by_hand(edges)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fan_counts_sites_not_rows(spark):
    rows = [(1, 2, "calls", "ambiguous", "f", 1, 10), (1, 3, "calls", "ambiguous", "f", 1, 10), (1, 2, "calls", "exact", "f", 2, 11), (4, 2, "hook", "hook", "f", 3, None), (4, 2, "hook", "hook", "f", 3, None), (None, 2, "calls", "exact", "f", 9, 12)]
    df = spark.createDataFrame(rows, "src long, dst long, kind string, resolution string, file string, line int, ref_id long")
    got = {r["id"]: (r["fan_in"], r["fan_out"], r["dependents"]) for r in centrality.fan(df).collect()}
    assert got == {1: (0, 2, 0), 2: (4, 0, 2), 3: (1, 0, 1), 4: (0, 2, 0)}
    counts = aggregates.site_counts(df, spark.createDataFrame([(1,)], "x int")).first().asDict()
    assert counts == {"edges_exact": 2, "edges_inferred": 0, "edges_ambiguous": 1, "edges_hook": 2, "edge_rows": 6, "unresolved": 1}


def symbols(spark, n):
    return spark.createDataFrame([(i, f"d{i % 3}/f{i % 2}.py", f"n{i}", "method" if i % 2 else "function", "C" if i % 2 else None, "python", i + 1, i, i + 1, i, "") for i in range(n)], "id long, file string, name string, kind string, container string, lang string, start_line int, start_byte long, end_byte long, end_line int, signature string")


def test_hotspots_flag_suspected_shadows(spark):
    df = frame(spark, [(1 + i % 50, 0) for i in range(150)] + [(2, 3)])
    got = centrality.hotspots(df, symbols(spark, 60), top="5").collect()
    assert (got[0]["id"], got[0]["fan_in"], got[0]["dependents"], got[0]["suspected_shadow"]) == (0, 150, 50, True)
    assert not got[1]["suspected_shadow"] and len(got) == 2


def test_lookups(spark):
    s = symbols(spark, 10)
    assert [r["id"] for r in lookups.qualified(s, "C.n3").collect()] == [3] and not lookups.qualified(s, "D.n3").collect()
    assert [r["id"] for r in lookups.qualified(s, "n4").collect()] == [4] and not lookups.find(s, "n4", kind="method").collect()
    assert {r["id"] for r in lookups.by_file(s, "f1.py").collect()} == {1, 3, 5, 7, 9}
    assert not lookups.by_file(s, "1.py").collect() and not lookups.by_file(s, "F1.py").collect()
    df = frame(spark, [(1, 2), (None, 1), (3, 1)])
    near = {(r["direction"], r["id"]) for r in lookups.neighbours(df, s, s.where("id = 1")).collect()}
    assert near == {("out", 2), ("in", 3)}
    assert {(r["src_label"], r["dst_label"]) for r in lookups.edge_labels(df, s).collect()} == {("C.n1", "n2"), ("<module>", "C.n1"), ("C.n3", "C.n1")}


def test_blast_radius_takes_the_least_depth(spark):
    s = symbols(spark, 6)
    got = traverse.blast_radius(frame(spark, [(1, 0), (2, 1), (2, 0), (3, 2)]), s, s.where("id in (0, 1)"), 6).collect()
    flat = {x["id"]: x["depth"] for r in got for x in r["impacted"]}
    assert flat == {1: 1, 2: 1, 3: 2}


def test_clamp():
    assert [traverse.clamp(x, 1, 25, 3) for x in (0, 7, 99, "4", "x", None, float("inf"))] == [1, 7, 25, 4, 3, 3, 3]


def test_changed_files(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "path string, hash string")
    assert [(r["path"], r["state"]) for r in changes.changed_files(now, old).collect()] == [("b", "modified"), ("c", "deleted"), ("d", "new")]


def test_suspects_trust_time_and_size(spark):
    now = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5), ("c", 1.0, 6), ("d", 1.0, 1)], "path string, mtime double, size long")
    old = spark.createDataFrame([("a", 1.0, 5, "h"), ("b", 1.0, 5, "h"), ("c", 1.0, 5, "h")], "path string, mtime double, size long, hash string")
    assert {r["path"] for r in changes.suspects(now, old).collect()} == {"b", "c", "d"}
    assert changes.suspects(now, old, force=True).count() == 4
    assert changes.removed(now.where("path <> 'a'"), old).select("path").collect()[0]["path"] == "a"


def test_edge_differences_show_a_change_of_tier(spark):
    cols = "file string, src_label string, dst_label string, resolution string"
    a = spark.createDataFrame([("f", "x", "Foo.save", "exact"), ("g", "y", "z", "exact")], cols)
    b = spark.createDataFrame([("f", "x", "Bar.save", "exact"), ("g", "y", "z", "ambiguous"), ("f", "x", "Bar.save", "exact")], cols)
    got = {r["file"]: (list(r["added"]), list(r["removed"])) for r in changes.edge_difference(a, b).collect()}
    assert got == {"f": (["x -> Bar.save [exact]"], ["x -> Foo.save [exact]"]), "g": (["y -> z [ambiguous]"], ["y -> z [exact]"])}


def test_an_empty_graph():
    g = Graph(*(__import__("numpy").empty(0, dtype="int64") for _ in range(2)))
    assert len(g) == 0 and g.shortest_path([1], {2}) is None and not len(g.components())


def test_label_of_symbols(spark):
    got = lookups.labelled(symbols(spark, 2)).orderBy("id").select(F.col("symbol")).collect()
    assert [r["symbol"] for r in got] == ["n0", "C.n1"]
