"""Degrees (D2), possible triplets (D6) and the degree filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.functions.scalars import pairs
from txgraph.operators.views import directed_edges, simple_edges, whole_edges

VIEWS = ("multi", "directed", "simple")


def _view_edges(edges: DataFrame, view: str) -> DataFrame:
    if view == "multi":
        return whole_edges(edges).select("src", "dst")
    if view == "directed":
        return directed_edges(edges)
    if view == "simple":
        return simple_edges(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    raise ValueError(f"view must be one of {VIEWS}, got {view!r}")


def degrees(edges: DataFrame, view: str = "multi",
            vertices: DataFrame | None = None) -> DataFrame:
    """``(id, in_degree, out_degree, degree)`` over the chosen edge view.

    On the multigraph a self-loop adds one in and one out (degree 2), as GraphX does.
    For ``view='simple'`` the stored orientation ``a < b`` is arbitrary, so only
    ``degree`` (the number of distinct neighbours) is meaningful.
    Each edge contributes one row per end; ``groupBy`` combines them map-side,
    so a hub costs one partial row per task before the shuffle.
    With ``vertices`` given, vertices without edges appear with zeros.
    """
    return count_ends(_view_edges(edges, view), view, vertices)


def count_ends(e: DataFrame, view: str = "multi", vertices: DataFrame | None = None) -> DataFrame:
    """:func:`degrees` of rows ``(src, dst)`` that are the edges of ``view`` already."""
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    deg = ends.groupBy("id").agg(
        F.sum("i").cast("bigint").alias("in_degree"),
        F.sum("o").cast("bigint").alias("out_degree"),
        F.count(F.lit(1)).alias("degree"),
    )
    if view == "simple":
        deg = deg.select("id", "degree")
    if vertices is not None:
        deg = vertices.select("id").distinct().join(deg, "id", "left").select(
            "id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
                    for c in deg.columns if c != "id"])
    return deg


def possible_triplets(edges: DataFrame, view: str = "directed") -> DataFrame:
    """``(id, degree, pairs)`` for vertices with degree >= 2, pairs = C(degree, 2)."""
    return _triplets(degrees(edges, view))


def _triplets(deg: DataFrame) -> DataFrame:
    return (
        deg.filter(F.col("degree") >= 2)
        .select("id", "degree", pairs(F.col("degree")).alias("pairs"))
    )


def degree_filter(edges: DataFrame, vertices: DataFrame | None = None,
                  view: str = "directed", min_degree: int = 2) -> DataFrame:
    """Vertices whose degree (default 0 when absent) is at least ``min_degree``."""
    from txgraph.operators.views import vertex_ids

    verts = vertex_ids(edges, vertices)
    return (
        degrees(edges, view, vertices=verts)
        .filter(F.col("degree") >= min_degree)
        .select("id", "degree")
    )


def degree_filter_graph(edges: DataFrame, vertices: DataFrame | None = None,
                        view: str = "directed", min_degree: int = 2) -> DataFrame:
    """B9 + B8: the graph masked to the vertices kept by :func:`degree_filter`."""
    from txgraph.operators.build import induced_edges

    keep = degree_filter(edges, vertices, view, min_degree).select("id")
    return induced_edges(edges, keep)
