"""Endpoints of one service share what they read, and their rows are those of the operators."""

import random

import pytest

from edgewright.functions.scalars import core_layer
from edgewright.operators import communities as C
from edgewright.operators import graph, metrics
from edgewright.operators import relations as R
from edgewright.plans.endpoints import Service

ENTITIES = "isgl1_key string, root_subfolder_l1 string, root_subfolder_l2 string"


@pytest.fixture(scope="module")
def edges(edges_of):
    rnd = random.Random(3)
    return edges_of(" ".join(f"{rnd.choice('abcdefghijklmn')}>{rnd.choice('ijklmnopqrstuvwxyzABC')}:{rnd.choice(['Calls', 'Uses', 'Implements', 'Other'])}" for _ in range(150)))


def rows(df, digits=9):
    short = lambda v: round(v, digits) if isinstance(v, float) else v
    return sorted(tuple((c, short(v)) for c, v in sorted(r.asDict().items())) for r in df.collect())


def counted(monkeypatch, module, name):
    calls, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(name), f(*a, **k))[1])
    return calls


def test_what_endpoints_share_is_derived_once(spark, edges, monkeypatch):
    derived = [counted(monkeypatch, R, "edge_types"), counted(monkeypatch, R, "edge_relation")]
    coded, measured = counted(monkeypatch, graph, "indexed"), counted(monkeypatch, metrics, "ck_metrics")
    s = Service(spark, spark.createDataFrame([], ENTITIES), edges)
    for ask in (s.hotspots, s.clusters, s.components, s.debt, s.kcore, s.centrality, s.entropy, s.coupling, s.communities):
        ask()
    assert (sum(map(len, derived)), len(coded), len(measured)) == (1, 1, 1)


def test_rows_by_ids_are_the_operators_rows(spark, edges):
    s, e = Service(spark, spark.createDataFrame([], ENTITIES), edges), R.edge_types(edges)
    assert rows(s.hotspots(5).data) == rows(metrics.hotspots(R.edge_pairs(edges), 5))
    for side, n in (("in", "n_in"), ("out", "n_out")):
        assert s.busiest(side) == min(metrics.degrees(R.edge_pairs(edges)).collect(), key=lambda r: (-r[n], r.key)).key
    assert rows(s.coupling().data) == rows(metrics.ck_metrics(e)) and rows(s.coupling("a").data) == rows(metrics.ck_metrics(e, "a"))
    assert rows(s.debt(min_debt=4.0).data) == rows(metrics.sqale_debt(e, 4.0))
    assert rows(s.entropy("b").data) == rows(metrics.edge_entropy(e, "b"))
    for method, f in (("pagerank", graph.pagerank), ("betweenness", graph.betweenness)):
        assert rows(s.centrality(method).data, 6) == rows(graph.ranked_scores(f(e)), 6)
    assert len(rows(s.centrality(top=3).data)) == 3


@pytest.mark.parametrize("most", [graph.CODED_EDGES, 0])
def test_groups_by_ids(spark, edges, monkeypatch, most):
    s, e = Service(spark, spark.createDataFrame([], ENTITIES), edges), R.edge_types(edges)
    labels, parts, moved = C.label_clusters(e, kernel=True), graph.components(e, True), C.communities(e, passes=1, kernel=True)
    cores = rows(graph.coreness(e, True).withColumn("layer", core_layer("coreness")))
    sizes, clusters = rows(graph.component_sizes(parts)), rows(C.cluster_edges(e, labels))
    members = rows(moved)
    monkeypatch.setattr(graph, "CODED_EDGES", most)
    a, g = s.components(), s._graph()
    assert rows(a.data) == sizes and sorted(r.key for r in a.extra["members"].collect()) == sorted(k for k, in parts.select("key").collect())
    assert rows(s.kcore().data) == cores and rows(s.clusters().data) == clusters
    assert rows(g.named(C.communities(g.typed, passes=1, groups=g.nodes), "key")) == members


@pytest.mark.parametrize("seed", range(2))
def test_kernels_with_own_edges(edges_of, seed):
    rnd = random.Random(seed)
    e = edges_of(" ".join(f"{rnd.choice('abcdefgh')}>{rnd.choice('abcdefgh')}" for _ in range(rnd.randrange(3, 30))))
    for f in (graph.coreness, graph.components):
        assert rows(f(e, True)) == rows(f(e, False))
