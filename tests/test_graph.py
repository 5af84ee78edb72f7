"""Golden values of small graphs, and the kernels against the joins."""

import math
import random

import pytest

from edgewright.operators import communities as C
from edgewright.operators import context, graph, metrics, traversal

G8 = "A>B A>C B>D C>D D>E E>F F>D G>H H>G"
CHAIN = "A>B B>C C>D D>E"


def as_dict(df, value):
    return {r["key"]: r[value] for r in df.collect()}


@pytest.mark.parametrize("kernel", [True, False])
def test_components(edges_of, kernel):
    got = as_dict(graph.components(edges_of(G8), kernel), "component")
    assert got == {"A": "A", "B": "B", "C": "C", "D": "D", "E": "D", "F": "D", "G": "G", "H": "G"}
    sizes = [(r.scc_id, r.component, r["size"], r.risk) for r in graph.component_sizes(graph.components(edges_of(G8), kernel)).orderBy("scc_id").collect()]
    assert sizes == [(0, "D", 3, "HIGH"), (1, "G", 2, "MEDIUM"), (2, "A", 1, "NONE"), (3, "B", 1, "NONE"), (4, "C", 1, "NONE")]


@pytest.mark.parametrize("kernel", [True, False])
def test_pagerank(edges_of, kernel):
    got = as_dict(graph.pagerank(edges_of(CHAIN), kernel=kernel), "score")
    assert [round(got[k], 4) for k in "ABCDE"] == [0.0812, 0.1502, 0.2088, 0.2587, 0.3011]
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-9)
    if kernel:
        got = as_dict(graph.pagerank(edges_of(G8)), "score")
        assert round(got["D"], 6) == 0.242711 and round(got["A"], 6) == 0.018750


@pytest.mark.parametrize("kernel", [True, False])
def test_betweenness(edges_of, kernel):
    got = as_dict(graph.betweenness(edges_of(G8), kernel), "score")
    assert got == {"A": 0, "B": 1.5, "C": 1.5, "D": 7, "E": 4, "F": 1, "G": 0, "H": 0}


@pytest.mark.parametrize("kernel", [True, False])
def test_coreness(edges_of, kernel):
    assert as_dict(graph.coreness(edges_of(G8), kernel), "coreness") == {**dict.fromkeys("ABCDEF", 2), "G": 1, "H": 1}
    assert as_dict(graph.coreness(edges_of("A>A A>B"), kernel), "coreness") == {"A": 1, "B": 1}


def brute_betweenness(edges):
    from collections import defaultdict, deque

    out = defaultdict(list)
    nodes = sorted({x for e in edges for x in e})
    for a, b in edges:
        out[a].append(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, before = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def test_random_graph_against_brute_force(spark, edges_of):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(18)}", f"n{rng.randrange(18)}") for _ in range(60)]
    e = spark.createDataFrame([(a, b, rng.choice(["Calls", "Uses"])) for a, b in pairs], "from_key string, to_key string, edge_type string").distinct()
    rows = [(r.from_key, r.to_key) for r in e.collect()]
    want = brute_betweenness(rows)
    for kernel in (True, False):
        got = as_dict(graph.betweenness(e, kernel, batch=7), "score")
        assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert as_dict(graph.components(e, True), "component") == as_dict(graph.components(e, False), "component")
    assert as_dict(graph.coreness(e, True), "coreness") == as_dict(graph.coreness(e, False), "coreness")
    # coreness by peeling
    near = {k: set() for k in want}
    for a, b in rows:
        near[a].add(b)
        near[b].add(a)
    left, core, k = dict(near), {}, 0
    while left:
        v = min(left, key=lambda x: len(near[x] & left.keys()))
        k = max(k, len(near[v] & left.keys()))
        core[v] = k
        del left[v]
    got = as_dict(graph.coreness(e, True), "coreness")
    assert {v: c for v, c in got.items() if v not in near[v]} == {v: c for v, c in core.items() if v not in near[v]}


def test_cycles(edges_of):
    got = sorted((r.length, r.path) for r in graph.cycles(edges_of(G8 + " A>A")).collect())
    assert got == [(1, ["A", "A"]), (2, ["G", "H", "G"]), (3, ["D", "E", "F", "D"])]
    assert graph.cycles(edges_of(CHAIN)).count() == 0
    text = "Z>A A>B B>C C>A B>A C>D D>C E>C D>E"
    assert sorted(r.path for r in graph.cycles(edges_of(text), kernel=True).collect()) == sorted(r.path for r in graph.cycles(edges_of(text), kernel=False).collect())


def test_cycles_by_joins(edges_of):
    """Components beyond the bound: simple cycles of the graph, and edges on none of them form no cycle."""
    rng = random.Random(5)
    pairs = {(f"n{a:02}", f"n{b:02}") for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(40))} | {("x1", "x2"), ("x2", "x1")}
    got = [(r.length, r.path) for r in graph.cycles(edges_of(" ".join(f"{a}>{b}" for a, b in sorted(pairs))), most_edges=2).collect()]
    assert (2, ["x1", "x2", "x1"]) in got and len(got) == len({tuple(p) for _, p in got})
    for length, path in got:
        assert length == len(path) - 1 == len(set(path)) and path[0] == path[-1] and set(zip(path, path[1:])) <= pairs
    left = pairs - {e for _, p in got for e in zip(p, p[1:])}
    while free := {e for e in left if e[1] not in {a for a, _ in left}}:
        left -= free
    assert not left


def test_empty_graph(spark):
    e = spark.createDataFrame([], "from_key string, to_key string, edge_type string")
    for f in (graph.components, graph.pagerank, graph.betweenness, graph.coreness, graph.cycles, metrics.ck_metrics, metrics.sqale_debt, metrics.edge_entropy, C.communities, C.label_clusters):
        assert f(e).count() == 0
    assert C.modularity(e, spark.createDataFrame([], "key string, community long")).first()[0] == 0


def test_ck_metrics(edges_of):
    got = {r.key: r for r in metrics.ck_metrics(edges_of(G8)).collect()}
    assert (got["D"].cbo, got["A"].cbo, got["A"].rfc, got["A"].wmc, got["D"].wmc, got["A"].lcom) == (4, 2, 3, 2, 1, 0)
    assert as_dict(metrics.cohesion(edges_of("A>B A>C B>D C>E")), "lcom")["A"] == 1.0
    assert as_dict(metrics.cohesion(edges_of("A>B A>C B>D C>D")), "lcom")["A"] == 0.0
    # parallel edges are children of their own: B, B, C with B sharing only with itself
    got = as_dict(metrics.cohesion(edges_of("A>B:Calls A>B:Uses A>C B>D C>E")), "lcom")["A"]
    assert math.isclose(got, 2 / 3)


def test_cohesion_against_brute_force(spark):
    rng = random.Random(3)
    rows = sorted({(f"a{rng.randrange(6)}", f"b{rng.randrange(9)}", "Calls") for _ in range(30)} | {(f"b{rng.randrange(9)}", f"c{rng.randrange(5)}", "Uses") for _ in range(25)})
    e = spark.createDataFrame(rows, "from_key string, to_key string, edge_type string")
    out = {}
    for a, b, _ in rows:
        out.setdefault(a, []).append(b)
    for k, v in as_dict(metrics.cohesion(e), "lcom").items():
        kids = out[k]
        n = [(x, y) for i, x in enumerate(kids) for y in kids[i + 1 :]]
        free = sum(not set(out.get(x, [])) & set(out.get(y, [])) for x, y in n)
        assert math.isclose(v, free / len(n) if n else 0.0, abs_tol=1e-12)


def test_entropy_and_debt(edges_of):
    three = as_dict(metrics.edge_entropy(edges_of("X>A X>B X>C:Uses X>D:Uses X>E:Implements X>F:Implements")), "entropy")
    assert math.isclose(three["X"], math.log2(3), abs_tol=1e-9) and three["A"] == 0
    two = {r.key: r for r in metrics.edge_entropy(edges_of("M>A M>B M>C M>D:Uses")).collect()}
    assert round(two["M"].entropy, 3) == 0.811 and two["M"].level == "LOW"
    # parallel edges count under the greatest type of their pair
    one = as_dict(metrics.edge_entropy(edges_of("A>B:Calls A>B:Uses")), "entropy")
    assert one["A"] == 0
    debt = {r.key: r for r in metrics.sqale_debt(edges_of(" ".join(f"X>t{i}" for i in range(16)))).collect()}["X"]
    assert (debt.debt_hours, debt.severity, debt.violations) == (14.0, "HIGH", ["CBO", "LCOM", "WMC"])


def test_modularity_and_communities(spark, edges_of):
    e = edges_of(G8)
    two = spark.createDataFrame([(k, 0 if k in "ABCDEF" else 1) for k in "ABCDEFGH"], "key string, community long")
    assert round(C.modularity(e, two).first()[0], 6) == 0.172840
    assert abs(C.modularity(edges_of("A>B B>A"), spark.createDataFrame([("A", 0), ("B", 0)], "key string, community long")).first()[0]) < 1e-12
    for kernel in (True, False):
        c = as_dict(C.communities(e, kernel=kernel), "community")
        assert c["G"] == c["H"] != c["A"] and len(set(c.values())) >= 2
        assert C.modularity(e, C.communities(e, kernel=kernel)).first()[0] > 0


def test_communities_at_every_size(edges_of):
    """The joins give the kernel's communities, however large the graph."""
    rng = random.Random(3)
    text = " ".join(f"n{rng.randrange(60)}>n{int(rng.random() ** 2 * 60)}:{rng.choice(['Calls', 'Uses'])}" for _ in range(200)) + " n1>n1"
    e = edges_of(text)
    assert as_dict(C.communities(e, kernel=True), "community") == as_dict(C.communities(e, kernel=False), "community")


def test_betweenness_estimate(edges_of):
    """All sources as pivots give the exact scores; fewer stay within the error they state."""
    e = edges_of("A>B A>C B>D C>D D>E E>F F>D G>H H>G")
    exact = as_dict(graph.betweenness(e), "score")
    assert as_dict(graph.betweenness_estimate(e, 100), "score") == exact and {r.error for r in graph.betweenness_estimate(e, 100).collect()} == {0.0}
    rows = graph.betweenness_estimate(e, 3).collect()
    assert len(rows) == 8 and all(abs(r.score - exact[r.key]) <= r.error for r in rows)


def test_label_clusters(edges_of):
    got = as_dict(C.label_clusters(edges_of("A>B B>C C>A X>Y Y>Z Z>X")), "label")
    text = "A>B B>C C>A A>D D>E E>F F>D G>G H>G"
    assert as_dict(C.label_clusters(edges_of(text), kernel=True), "label") == as_dict(C.label_clusters(edges_of(text), kernel=False), "label")
    assert len({got[k] for k in "ABC"}) == 1 and len({got[k] for k in "XYZ"}) == 1 and got["A"] != got["X"]
    rows = C.cluster_edges(edges_of("A>B B>C C>A X>Y Y>Z Z>X C>X"), C.label_clusters(edges_of("A>B B>C C>A X>Y Y>Z Z>X"))).orderBy("cluster_id").collect()
    assert [(r.entity_count, r.internal_edges, r.external_edges) for r in rows] == [(3, 3, 1), (3, 3, 1)]


def test_traversal(spark, edges_of):
    e = edges_of("A>B B>C C>D A>C")
    assert {(r.node, r.distance) for r in traversal.impact_forward(e, "A", 1).collect()} == {("B", 1), ("C", 1)}
    assert {(r.node, r.distance) for r in traversal.impact_forward(e, "A", 5).collect()} == {("B", 1), ("C", 1), ("D", 2)}  # the shorter way counts
    assert traversal.impact_forward(e, "A", 0).count() == 0
    loop = edges_of("A>B B>C C>A")
    for kernel in (True, False):
        assert {r.node for r in traversal.reachable(loop, "A", kernel).collect()} == {"A", "B", "C"}
    assert {(r.hop, r.from_key) for r in traversal.impact_backward(loop, "A", 9).collect()} == {(1, "C"), (2, "B")}
    named = spark.createDataFrame([("x", "rust:fn:f:a:1-2"), ("y", "go:fn:f:p:T1"), ("z", "x")], "from_key string, to_key string")
    assert {(r.hop, r.from_key) for r in traversal.impact_backward(named, "go:fn:f:p:T1", 2).collect()} == {(1, "x"), (1, "y"), (2, "z")}


def test_callers_by_name(edges_of):
    rows = [("x", "python:fn:run:p:T1"), ("y", "rust:fn:run:unresolved-reference:0-0"), ("z", "rust:fn:runner:q:0-0"), ("w", "rust:method:run:m:T2"), ("v", "java:fn:run:m:T2")]
    from pyspark.sql import SparkSession

    e = SparkSession.getActiveSession().createDataFrame([(a, b, "Calls", None) for a, b in rows], "from_key string, to_key string, edge_type string, source_location string")
    got = traversal.callers(e, "python:fn:run:p:T1").collect()
    assert {r.from_key for r in got} == {"x", "y", "w"} and {r.source_location for r in got} == {"unknown"}


def test_smart_context(edges_of):
    e = edges_of("U>F F>A F>B A>C C>D D>E E>Z")
    got = context.smart_context(e, "F", 100_000).collect()
    assert [(r.key, r.relevance_type) for r in got] == [("U", "direct_caller"), ("A", "direct_callee"), ("B", "direct_callee"), ("C", "transitive_depth_2"), ("D", "transitive_depth_3"), ("E", "transitive_depth_4")]
    # an item that does not fit is passed over, a later smaller one is taken
    long, short = "L" * 400, "S"
    e = edges_of(f"{long}>F F>{short}")
    assert [r.key for r in context.smart_context(e, "F", 120).collect()] == [short]


def test_smart_context_order(edges_of):
    """Callers and callees by key, then least distances; a later item that still fits is taken: against a plain walk."""
    keys = [f"k{i:03}" + "x" * (i * 37 % 300) for i in range(60)]
    pairs = [(k, "F") if i % 2 else ("F", k) for i, k in enumerate(keys)] + [(keys[0], "T"), ("T", "V"), ("U", "F"), ("F", "U"), (keys[2], "V")]
    e = edges_of(" ".join(f"{a}>{b}" for a, b in pairs))
    rank = {"F": -1} | {a: 0 for a, b in pairs if b == "F"}
    near = {"F"}
    for d in range(1, 5):
        near = {b for a, b in pairs if a in near}
        for k in near:
            rank.setdefault(k, d)
    for budget in (99, 250, 1234, 4000, 100_000):
        want, used = [], 0
        for r, k in sorted((r, k) for k, r in rank.items() if r >= 0):
            cost = 100 + len(k) // 10
            if used + cost <= budget:
                used += cost
                want.append((len(want) + 1, k, cost))
        assert [(r.position, r.key, r.estimated_tokens) for r in context.smart_context(e, "F", budget).collect()] == want


def test_hub(edges_of):
    text = " ".join(f"hub>s{i}" for i in range(500)) + " " + " ".join(f"c{i}>c{i + 1}:Uses" for i in range(499)) + " hub>c0"
    e = edges_of(text)
    assert graph.components(e).count() == 1001 and graph.coreness(e).count() == 1001
    assert metrics.ck_metrics(e).filter("key = 'hub'").first().cbo == 501


def tangle(rng, n, m):
    return sorted({(f"k{rng.randrange(n):03}", f"k{rng.randrange(n):03}") for _ in range(m)})


def no_joins(monkeypatch, *names):
    """Graphs of more than a few edges, which are not to go through the joins named."""
    monkeypatch.setattr(graph, "KERNEL_EDGES", 5)
    for module, name in names:
        monkeypatch.setattr(module, name, lambda *a, **k: pytest.fail(f"{name} was called"))


def test_cycles_of_larger_graphs(edges_of, monkeypatch):
    """Beyond the kernels with keys the components come from one task too, and the cycles are those of the search in key order."""
    e = edges_of(" ".join(f"{a}>{b}" for a, b in tangle(random.Random(9), 60, 150)))
    want = sorted((r.length, r.path) for r in graph.cycles(e, kernel=True).collect())
    parts = as_dict(graph.components(e, True), "component")
    no_joins(monkeypatch, (graph, "_scc_joins"))
    monkeypatch.setattr(graph, "KEYS_PER_TASK", 40)
    assert len(want) > 20 and sorted((r.length, r.path) for r in graph.cycles(e, 500_000).collect()) == want
    assert as_dict(graph.components(e), "component") == parts


def test_tasks_share_the_cycles_of_a_component(monkeypatch):
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    rows = pd.DataFrame(tangle(random.Random(4), 40, 120), columns=["from_key", "to_key"])
    one = graph._packed(rows).iloc[0]
    args = pa.array(one["names"]), np.frombuffer(one["start"], np.int32), np.frombuffer(one["to"], np.int32)
    monkeypatch.setattr(graph, "KEYS_PER_BATCH", 25)
    found = lambda part, parts: [p for b in graph._cycle_batches(*args, part, parts) for p in b.column("path").to_pylist()]
    whole = found(0, 1)
    shares = [found(i, 3) for i in range(3)]
    assert all(shares) and sorted(p for s in shares for p in s) == sorted(whole)
    assert sum(map(len, whole)) == one["n"]


def test_communities_of_larger_graphs(edges_of, monkeypatch):
    e = edges_of(" ".join(f"{a}>{b}" for a, b in tangle(random.Random(11), 50, 120)))
    want = as_dict(C.communities(e, kernel=True), "community")
    no_joins(monkeypatch, (C, "_moving_joins"))
    assert len(set(want.values())) > 3 and as_dict(C.communities(e), "community") == want


def test_cycle_inspection():
    """In one pass: each step once, the first keys, and what is no simple closed path."""
    import pyarrow as pa

    rows = [(2, ["a", "b", "a"]), (3, ["a", "b", "c", "a"]), (1, ["x", "x"]), (3, ["p", "q", "p", "p"]), (1, ["u", "w"]), (5, ["h", "i", "h"])]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int32()), pa.array([p for _, p in part], pa.list_(pa.string()))], ["length", "path"])
    got = [r for b in graph._looked_at(iter([batch(rows[:2]), batch(rows[2:]).slice(0)])) for r in b.to_pylist()]
    assert [r["n"] for r in got if r["from_key"] is None] == [3]
    assert sorted(r["from_key"] for r in got if r["from_key"] and not r["to_key"]) == ["a", "h", "p", "u", "x"]
    steps = [(r["from_key"], r["to_key"]) for r in got if r["to_key"]]
    assert len(steps) == len(set(steps)) and set(steps) == {s for _, p in rows for s in zip(p, p[1:])}


def test_cycle_check_reads_the_edges_once(spark, tmp_path, monkeypatch):
    """The cycles' paths are looked at where they arise: none is written beside the edges."""
    from edgewright.plans import graph_queries as Q

    rows = [(a, b, "Calls") for a, b in tangle(random.Random(2), 60, 150)]
    spark.createDataFrame(rows, "from_key string, to_key string, edge_type string").write.parquet(str(tmp_path / "edges.parquet"))
    monkeypatch.setattr(Q.graph, "cycles", lambda *a: pytest.fail("the paths were written"))
    e = spark.createDataFrame(rows, "from_key string, to_key string, edge_type string")
    part, loops = as_dict(graph.components(e), "component"), {a for a, b, _ in rows if a == b}
    sizes = [c for c in set(part.values()) if sum(x == c for x in part.values()) > 1 or c in loops]
    assert tuple(Q.cycle_check(spark, str(tmp_path)).first()) == (len(sizes), 0, 0, 0)


def test_betweenness_of_larger_graphs(edges_of, monkeypatch):
    """Beyond the kernels with keys the sources are still shared by tasks that hold the graph, not taken in batches of joins."""
    rows = tangle(random.Random(13), 40, 90)
    want = brute_betweenness(rows)
    no_joins(monkeypatch, (graph, "_betweenness_joins"))
    got = as_dict(graph.betweenness(edges_of(" ".join(f"{a}>{b}" for a, b in rows))), "score")
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_cycles_by_hashes(edges_of, monkeypatch):
    """Keys are not moved with the edges: the components come from hashes; deliveries may repeat, and large components are shared by tasks."""
    rows = tangle(random.Random(21), 60, 150)
    e = edges_of(" ".join(f"{a}>{b}" for a, b in rows + rows[:40]) + " x>y y>z z>x é>é")
    want = sorted((r.length, r.path) for r in graph.cycles(e, kernel=True).collect())
    monkeypatch.setattr(graph, "inner_edges", lambda *a: pytest.fail("the keys were moved"))
    assert len(want) > 20 and sorted((r.length, r.path) for r in graph.cycles(e).collect()) == want
    monkeypatch.setattr(graph, "KEYS_PER_TASK", 40)
    monkeypatch.setattr(graph, "BUNDLE_EDGES", 2)
    for most in (500_000, 0):
        monkeypatch.setattr(graph, "BROADCAST_NODES", most)
        assert sorted((r.length, r.path) for r in graph.cycles(e).collect()) == want
    # components beyond the kernels with keys are searched in key order too
    monkeypatch.setattr(graph, "KERNEL_EDGES", 2)
    assert sorted((r.length, r.path) for r in graph.cycles(e).collect()) == want


def test_cycles_where_hashes_meet(edges_of, monkeypatch):
    """Keys of one hash: found out where one is on a cycle, without harm where none is, and the cycles are those of the keys."""
    text = "a>b b>a bb>cc cc>c c>dd ddd>e"
    want = [(2, ["a", "b", "a"])]
    inner, called = graph.inner_edges, []
    monkeypatch.setattr(graph, "inner_edges", lambda *a: called.append(a) or inner(*a))
    for hash_, falls_back in ((lambda k: graph.F.length(k).cast("long"), True), (lambda k: graph.F.ascii(graph.F.col(k)).cast("long"), True), (lambda k: graph.F.when(graph.F.col(k).isin("cc", "ddd"), 7).otherwise(graph.F.xxhash64(k)), False)):
        monkeypatch.setattr(graph, "_hash", hash_)
        called.clear()
        assert [(r.length, r.path) for r in graph.cycles(edges_of(text)).collect()] == want
        assert bool(called) == falls_back


def test_paths_of_cycles_share_a_dictionary(spark, edges_of, tmp_path):
    """A result of paths names each key once a row group, not once a path."""
    import pyarrow.parquet as pq

    keys = [f"{i:04d}" + "key" * 500 for i in range(1000)]
    e = edges_of(" ".join([f"{a}>{b}" for a, b in zip(keys, keys[1:])] + [f"{keys[-1]}>{k}" for k in keys[:40]]))
    graph.cycles(e).coalesce(1).write.parquet(str(tmp_path / "out"))
    column = next(c for f in (tmp_path / "out").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] if m.num_rows for c in [m.row_group(0).column(1)])
    assert column.total_uncompressed_size < 4_000_000  # 40 paths of a thousand keys are 60 MB, the keys 1.5 MB
