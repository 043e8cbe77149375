"""Clustering coefficients.

Views (see ``views``): the local coefficient and its average use the *simple* graph;
the global coefficient and transitivity use the *dedup-directed* degree by default,
as the source computes them (``view='simple'`` gives the textbook definitions).

Scalars are single-row aggregates over a union of tagged rows, so no two
aggregates are ever combined with a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.functions.scalars import pairs, ratio
from txgraph.operators.degrees import count_ends, degrees
from txgraph.operators.triangles import triangle_total, vertex_triangles
from txgraph.operators.views import directed_edges, simple_edges
from txgraph.operators.written import write


def local_clustering(edges: DataFrame, tpv: DataFrame | None = None) -> DataFrame:
    """``(id, neighbours, edges_between, coefficient)`` for vertices with >= 2 neighbours.

    ``edges_between`` = links among the neighbours = triangles at the vertex;
    ``coefficient = 2 t / (k (k - 1))``; zero coefficients are kept.
    """
    if tpv is None:         # the source is read once
        edges = write(simple_edges(edges))[0].select(F.col("a").alias("src"), F.col("b").alias("dst"))
        k = count_ends(edges, "simple")
    else:
        k = degrees(edges, "simple")
    t = vertex_triangles(edges) if tpv is None else tpv
    k = k.filter(F.col("degree") >= 2).select(
        "id", F.col("degree").alias("neighbours"))
    return k.join(t, "id", "left").select(
        "id", "neighbours",
        F.coalesce("t", F.lit(0).cast("bigint")).alias("edges_between"),
    ).withColumn(
        "coefficient",
        ratio(2 * F.col("edges_between"), F.col("neighbours") * (F.col("neighbours") - 1)),
    )


def average_clustering(edges: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """One row ``(average_clustering)``: mean local coefficient; NULL if none."""
    local = local_clustering(edges) if local is None else local
    return local.agg(F.avg("coefficient").alias("average_clustering"))


def local_split(edges: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """One row ``(zero_vertices, nonzero_vertices)`` of the local coefficients."""
    local = local_clustering(edges) if local is None else local
    return local.agg(
        F.count_if(F.col("coefficient") == 0).alias("zero_vertices"),
        F.count_if(F.col("coefficient") != 0).alias("nonzero_vertices"),
    )


def _degrees_once(edges: DataFrame, view: str, tpv: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Edges for the triangles and the degrees of ``view``. Where both are needed, the source is
    read once: its distinct directed pairs are written, and both derive from them."""
    if tpv is not None or view != "directed":
        return edges, degrees(edges, view)
    pairs, _ = write(directed_edges(edges))
    return pairs, count_ends(pairs)


def global_clustering(edges: DataFrame, view: str = "directed",
                      tpv: DataFrame | None = None) -> DataFrame:
    """One row ``(global_clustering)``.

    Mean over vertices with degree >= 2 (in ``view``) of ``triangles / C(degree, 2)``.
    A vertex whose only neighbour is reciprocal has directed degree 2 and adds a 0.
    """
    edges, deg = _degrees_once(edges, view, tpv)
    t = vertex_triangles(edges) if tpv is None else tpv
    d = deg.filter(F.col("degree") >= 2).select("id", "degree")
    return d.join(t, "id", "left").agg(
        F.avg(ratio(F.coalesce("t", F.lit(0)), pairs("degree"))).alias("global_clustering"))


def transitivity(edges: DataFrame, view: str = "directed",
                 tpv: DataFrame | None = None) -> DataFrame:
    """One row ``(transitivity)`` = 3 * triangles / sum of C(degree, 2), both exact
    decimals until the final ratio."""
    dec = "decimal(38,0)"
    edges, deg = _degrees_once(edges, view, tpv)
    tri = triangle_total(edges, tpv).select(
        (F.col("triangles").cast("decimal(20,0)") * 3).cast(dec).alias("tri"),
        F.lit(0).cast("bigint").alias("pairs"))
    d = deg.filter(F.col("degree") >= 2)
    stacked = tri.unionByName(
        d.select(F.lit(0).cast(dec).alias("tri"), pairs("degree").alias("pairs")))
    return stacked.agg(
        ratio(F.sum("tri"), F.sum(F.col("pairs").cast("decimal(28,0)"))).alias("transitivity"))
