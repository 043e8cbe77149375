"""Graph report (D18) and the single-row combinator it is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine single-row frames with distinct columns into one row.

    The frames are stacked with ``unionByName`` (missing columns NULL) and folded
    with ``max``: one aggregate instead of a chain of one-row joins.
    """
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def graph_report(edges: DataFrame, vertices: DataFrame | None = None, k: int = 1,
                 max_steps: int = 5, view: str = "directed",
                 formula: str = "half_intra") -> DataFrame:
    """The analysis job's figures in one row.

    Whole graph: ``vertices, edges, global_clustering, transitivity, average_clustering,
    zero_local_vertices, nonzero_local_vertices, components``. Greatest component
    (``k`` greatest): ``greatest_vertices, greatest_edges, clusters`` (label
    propagation with ``max_steps``) and ``modularity`` of that clustering.
    """
    from txgraph.operators import clustering as C
    from txgraph.operators import community as CM
    from txgraph.operators import components as CC
    from txgraph.operators.triangles import vertex_triangles
    from txgraph.operators.views import directed_edges, vertex_ids, whole_edges
    from txgraph.session import cut_table

    # The edge table feeds a dozen branches: written once. The views derive from one another.
    edges = cut_table(whole_edges(edges).select("src", "dst", "value"))
    verts = cut_table(vertex_ids(edges, vertices))
    pairs = cut_table(directed_edges(edges))
    tpv = cut_table(vertex_triangles(pairs))
    local = cut_table(C.local_clustering(pairs, tpv))
    comps = cut_table(CC.connected_components(pairs, verts))
    gv, ge = map(cut_table, CC.top_components(edges, comps, k))
    labels = CM.label_propagation(ge, max_steps, gv.select("id"))
    split = C.local_split(pairs, local).select(
        F.col("zero_vertices").alias("zero_local_vertices"),
        F.col("nonzero_vertices").alias("nonzero_local_vertices"))
    return one_row(
        verts.agg(F.count(F.lit(1)).alias("vertices")),
        edges.agg(F.count(F.lit(1)).alias("edges")),
        C.global_clustering(pairs, view, tpv),
        C.transitivity(pairs, view, tpv),
        C.average_clustering(pairs, local),
        split,
        comps.agg(F.count_distinct("component").alias("components")),
        gv.agg(F.count(F.lit(1)).alias("greatest_vertices")),
        ge.agg(F.count(F.lit(1)).alias("greatest_edges")),
        CM.cluster_count(labels),
        CM.modularity(ge, labels, formula),
    ).select("vertices", "edges", "global_clustering", "transitivity", "average_clustering",
             "zero_local_vertices", "nonzero_local_vertices", "components",
             "greatest_vertices", "greatest_edges", "clusters", "modularity")
