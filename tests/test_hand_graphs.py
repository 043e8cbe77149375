"""Hand graphs: the reference's three unit graphs plus ours for the untested operators."""

import pytest
from pyspark.sql import functions as F

from txgraph.operators import clustering as C
from txgraph.operators import community as CM
from txgraph.operators import components as CC
from txgraph.operators import degrees as D
from txgraph.operators import triangles as T

G_GLOBAL = [(3, 7), (3, 2), (2, 7), (7, 5), (2, 5)]
G_LOCAL = [(1, 2), (1, 6), (3, 1), (3, 6), (6, 2), (6, 4), (2, 4), (5, 6)]
G_TRANS = [(1, 3), (3, 2), (1, 2), (2, 6)]
G_BRIDGE = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
G_VIEWS = [(1, 2), (2, 1), (2, 3), (3, 1), (3, 3), (1, 2)]


def scalar(df):
    return df.first()[0]


def test_global_graph(edges):
    e = edges(G_GLOBAL)
    assert scalar(C.global_clustering(e)) == pytest.approx(0.833333, abs=1e-6)
    assert scalar(C.average_clustering(e)) == pytest.approx(0.833333, abs=1e-6)
    assert scalar(C.transitivity(e)) == pytest.approx(0.75)
    local = {r.id: r.coefficient for r in C.local_clustering(e).collect()}
    assert local == pytest.approx({2: 2 / 3, 3: 1.0, 5: 1.0, 7: 2 / 3})


def test_local_graph(edges):
    e = edges(G_LOCAL)
    local = {r.id: r.coefficient for r in C.local_clustering(e).collect()}
    assert local == pytest.approx({1: 2 / 3, 2: 2 / 3, 3: 1.0, 4: 1.0, 6: 0.3})
    assert 5 not in local
    assert scalar(C.average_clustering(e)) == pytest.approx(0.726667, abs=1e-6)
    assert scalar(C.transitivity(e)) == pytest.approx(0.5)
    assert scalar(T.triangle_total(e)) == 3


def test_transitivity_graph(edges):
    e = edges(G_TRANS)
    assert scalar(C.transitivity(e)) == pytest.approx(0.6)
    local = {r.id: r.coefficient for r in C.local_clustering(e).collect()}
    assert local == pytest.approx({1: 1.0, 2: 1 / 3, 3: 1.0})
    assert scalar(C.average_clustering(e)) == pytest.approx(0.777778, abs=1e-6)


def test_edge_views(edges):
    e = edges(G_VIEWS)
    simple = {r.id: r.degree for r in D.degrees(e, "simple").collect()}
    directed = {r.id: r.degree for r in D.degrees(e, "directed").collect()}
    multi = {r.id: (r.in_degree, r.out_degree, r.degree) for r in D.degrees(e, "multi").collect()}
    assert simple == {1: 2, 2: 2, 3: 2}
    assert directed == {1: 3, 2: 3, 3: 2}
    assert multi[3] == (2, 2, 4)  # the self-loop adds one in and one out
    assert sum(d for _, _, d in multi.values()) == 2 * 6
    assert scalar(T.triangle_total(e)) == 1
    assert scalar(C.transitivity(e, "simple")) == pytest.approx(1.0)
    assert scalar(C.transitivity(e)) == pytest.approx(3 / 7)
    assert scalar(C.global_clustering(e)) == pytest.approx(5 / 9)


def test_reciprocal_pair(edges):
    e = edges([(1, 2), (2, 1)])
    assert scalar(C.global_clustering(e)) == 0.0
    assert scalar(C.transitivity(e)) == 0.0
    assert scalar(C.global_clustering(e, "simple")) is None
    assert scalar(C.average_clustering(e)) is None


def test_empty_graph(edges):
    e = edges([])
    assert scalar(C.transitivity(e)) is None
    assert scalar(C.global_clustering(e)) is None
    assert scalar(T.triangle_total(e)) == 0
    assert CC.connected_components(e).count() == 0


def test_star_has_no_triangle(edges):
    e = edges([(0, i) for i in range(1, 200)])
    assert scalar(T.triangle_total(e)) == 0
    assert scalar(C.transitivity(e)) == 0.0
    comps = CC.connected_components(e)
    assert comps.select("component").distinct().collect()[0][0] == 0
    assert comps.count() == 200


def test_components_with_isolate(spark, edges):
    e = edges([(1, 2)])
    v = spark.createDataFrame([(1,), (2,), (9,)], "id bigint")
    comps = {r.id: r.component for r in CC.connected_components(e, v).collect()}
    assert comps == {1: 1, 2: 1, 9: 9}
    labels = {r.id: r.label for r in CM.label_propagation(e, 5, v).collect()}
    assert labels[9] == 9


def test_components_long_path(edges):
    # a path needs many label-propagation rounds but few star rounds
    n = 300
    e = edges([(i, i + 1) for i in range(n)] + [(1000 + i, 1001 + i) for i in range(50)])
    comps = CC.connected_components(e)
    sizes = {r.component: r.size for r in CC.component_sizes(comps).collect()}
    assert sizes == {0: n + 1, 1000: 51}
    top_v, top_e = CC.top_components(e, comps, 1)
    assert top_v.count() == n + 1 and top_e.count() == n


def test_bridge_communities(edges):
    e = edges(G_BRIDGE)
    labels = {r.id: r.label for r in CM.label_propagation(e, 5).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 4: 3, 5: 3, 6: 3}
    two = e.sparkSession.createDataFrame(
        [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)], "id bigint, label bigint")
    assert scalar(CM.modularity(e, two, "half_intra")) == pytest.approx(0.265306, abs=1e-6)
    assert scalar(CM.modularity(e, two, "standard")) == pytest.approx(0.357143, abs=1e-6)
    one = two.withColumn("label", F.lit(1).cast("bigint"))
    assert scalar(CM.modularity(e, one, "half_intra")) == pytest.approx(0.25)
    assert scalar(CM.modularity(e, one, "standard")) == pytest.approx(0.0)
    assert scalar(CM.cluster_count(two)) == 2
    links = {(r.label, r.other): r.weight for r in CM.cluster_links(e, two).collect()}
    assert links == {(1, 1): 3.0, (4, 4): 3.0, (1, 4): 1.0, (4, 1): 1.0}


def test_triangle_invariants(edges):
    import random

    rnd = random.Random(7)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(300)]
    e = edges(pairs)
    per = T.triangle_count(e)
    assert per.agg(F.sum("triangles")).first()[0] == 3 * scalar(T.triangle_total(e))
    # brute force on the simple graph
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    brute = sum(1 for a in adj for b in adj[a] for c in adj[b] if a < b < c and c in adj[a])
    assert scalar(T.triangle_total(e)) == brute


def test_hub_holding_a_third_of_edges(spark, edges):
    """A hub with a third of all edge rows: triangles, components and labels stay exact."""
    from txgraph.operators import skew

    ring = [(i, i + 1) for i in range(1, 400)] + [(400, 1)]
    hub = [(0, i) for i in range(1, 201)]  # 200 of 600 rows
    e = edges(ring + hub)
    # hub closes a triangle with every ring edge among its neighbours 1..200 (199 of them)
    assert scalar(T.triangle_total(e)) == 199
    per = {r.id: r.triangles for r in T.triangle_count(e).collect()}
    assert per[0] == 199 and per[1] == 1 and per[300] == 0
    deg = D.degrees(e, "simple")
    hot = {r.id for r in skew.heavy_keys(deg, "id", "degree", max_keys=10).collect()}
    assert hot == {0}
    comps = CC.connected_components(e)
    assert comps.select("component").distinct().count() == 1
    labels = CM.label_propagation(e, 5)
    assert labels.count() == 401
