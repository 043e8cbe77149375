"""Triangles (D4, D5) by degree-ordered wedge closing.

Plan (Cohen 2009; Suri & Vassilvitskii 2011):

1. simple edges ``U(a, b)``, written once, and their degrees; ends of degree 1 close nothing:
   their edges go, again and again as long as a round takes a third of the edges or more;
2. orient every edge from the lower to the higher ``(degree, id)`` rank;
3. collect the upper neighbours of each vertex, by rising rank. Two edges out of one vertex ``u``
   make a wedge ``v - u - w``, so an edge ``u -> v`` carries those of ``u`` above ``v`` to ``v``; the
   ones that ``v`` has too close a triangle. Every triangle is found exactly once, at its lowest
   corner.

Under that orientation a vertex's out-degree is at most ``sqrt(2|U|)``, which bounds every array: a
hub's edges point *into* it, so no hub expands its own neighbour pairs. The wedges are ``O(|U|^1.5)``
numbers in one row an edge; the nearer ``v`` is to the top, the fewer reach it. All sides are written
tables. In the degree joins small ones are broadcast by Spark's size check; all else, the arrays too,
is shuffled plainly, where the adaptive skew split deals the hubs of the degree joins and those that a
third of all edges lead to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.operators.views import simple_edges, vertex_ids
from txgraph.operators.written import write


def oriented_edges(edges: DataFrame) -> DataFrame:
    """Simple edges between ends of degree 2 or more, oriented low->high by (degree, id):
    ``(lo, hi, dhi)``, a written table. Degrees are those before the last trimming."""
    u, rows = write(simple_edges(edges))
    while True:
        deg, _ = write(u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count())
        x = u.join(deg.select(F.col("id").alias("a"), F.col("count").alias("da")), "a").join(
            deg.select(F.col("id").alias("b"), F.col("count").alias("db")), "b").filter(
            (F.col("da") > 1) & (F.col("db") > 1))
        # a < b always holds in U, so equal degrees resolve to a -> b.
        a_low = F.col("da") <= F.col("db")
        o, left = write(x.select(
            F.when(a_low, F.col("a")).otherwise(F.col("b")).alias("lo"),
            F.when(a_low, F.col("b")).otherwise(F.col("a")).alias("hi"),
            F.when(a_low, F.col("db")).otherwise(F.col("da")).alias("dhi")))
        if 3 * left > 2 * rows or not left:
            return o
        u, rows = o.select(F.least("lo", "hi").alias("a"), F.greatest("lo", "hi").alias("b")), left


def upper_neighbours(o: DataFrame) -> DataFrame:
    """``(u, up)``: the ends of the oriented edges out of ``u``, by rising (degree, id) rank."""
    return o.groupBy(F.col("lo").alias("u")).agg(F.sort_array(F.collect_list(F.struct("dhi", "hi"))).alias("x")).select(
        "u", F.col("x.hi").alias("up"))


def closed_wedges(edges: DataFrame) -> DataFrame:
    """``(u, v, w)``: the triangles, corners by rising (degree, id) rank."""
    near, _ = write(upper_neighbours(oriented_edges(edges)))
    above = F.slice("up", F.col("pos") + 2, F.size("up"))
    wedges = near.filter(F.size("up") > 1).select("u", "up", F.posexplode("up").alias("pos", "v")).filter(
        F.col("pos") < F.size("up") - 1).select("u", "v", above.alias("ws"))
    # merged: Spark takes the exploded rows for as small as the table they come from and would broadcast them
    return wedges.join(near.select(F.col("u").alias("v"), "up").hint("merge"), "v").select(
        "u", "v", F.explode(F.array_intersect("ws", "up")).alias("w"))


def triangles(edges: DataFrame) -> DataFrame:
    """D4 listing: one row ``(a, b, c)`` with ``a < b < c`` per triangle of the simple graph."""
    t = closed_wedges(edges)
    low, high = F.least("u", "v", "w"), F.greatest("u", "v", "w")
    middle = F.greatest(F.least("u", "v"), F.least(F.greatest("u", "v"), "w"))
    return t.select(low.alias("a"), middle.alias("b"), high.alias("c"))


def vertex_triangles(edges: DataFrame, tri: DataFrame | None = None) -> DataFrame:
    """``(id, t)``: triangles per vertex, only for vertices that close at least one; ``tri``: a
    listing at hand.

    Each triangle counts at its three corners; the ``groupBy`` combines them map-side. This is the
    table the clustering coefficients share (one row per vertex, not per triangle).
    """
    corners = closed_wedges(edges).select(F.array("u", "v", "w").alias("x")) if tri is None else (
        tri.select(F.array("a", "b", "c").alias("x")))
    return corners.select(F.explode("x").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))


def triangle_count(edges: DataFrame, vertices: DataFrame | None = None,
                   tpv: DataFrame | None = None) -> DataFrame:
    """D4 per vertex: ``(id, triangles)`` for every vertex, 0 where it closes none."""
    tpv = vertex_triangles(edges) if tpv is None else tpv
    return vertex_ids(edges, vertices).join(tpv, "id", "left").select(
        "id", F.coalesce("t", F.lit(0).cast("bigint")).alias("triangles"))


def triangle_total(edges: DataFrame, tpv: DataFrame | None = None) -> DataFrame:
    """One row ``(triangles)``; a given per-vertex table is summed and divided by 3 in
    integers."""
    if tpv is not None:
        return tpv.agg(F.coalesce(F.expr("sum(t) div 3"), F.lit(0).cast("bigint")).alias("triangles"))
    return closed_wedges(edges).agg(F.count(F.lit(1)).alias("triangles"))
