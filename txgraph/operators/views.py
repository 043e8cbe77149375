"""Edge views (B5, B6, B7, D3) and vertex completion.

Every graph operator picks one of three views of the loaded multigraph
``edges(src, dst, value)``:

* **multigraph** - rows as loaded: parallel edges and self-loops kept;
* **dedup-directed** - distinct ``(src, dst)``, self-loops dropped;
* **simple** - distinct unordered ``{a, b}`` stored as ``a < b``, self-loops dropped.

An edge with a missing end (a transaction without receiver, which ingest keeps by default)
is no graph edge: it is in none of the views (``whole_edges``). Its other end is a vertex.

All of them are plain projections, filters and ``distinct`` (a hash aggregate with a
map-side partial step, so a hub's duplicate rows are combined before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_edges(edges: DataFrame) -> DataFrame:
    """The graph's edges: the rows with both ends."""
    return edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def drop_self_loops(edges: DataFrame) -> DataFrame:
    """Keep edges whose ends differ (pushed into the scan by Catalyst)."""
    return edges.filter(F.col("src") != F.col("dst"))


def merge_parallel(edges: DataFrame, value: str = "value") -> DataFrame:
    """One edge per directed pair; the attribute kept is the smallest one.

    Reciprocal pairs ``a->b`` and ``b->a`` stay two edges.
    """
    return whole_edges(edges).groupBy("src", "dst").agg(F.min(value).alias(value))


def directed_edges(edges: DataFrame) -> DataFrame:
    """Dedup-directed view: distinct ``(src, dst)`` without self-loops (B6 then B5)."""
    return drop_self_loops(edges).select("src", "dst").distinct()


def simple_edges(edges: DataFrame) -> DataFrame:
    """Simple undirected edges ``(a, b)`` with ``a < b``."""
    return (
        drop_self_loops(edges)
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """D3: flat neighbour table ``(id, nb)``: direction and multiplicity ignored.

    The reference keeps a ``Set`` per vertex; a flat table keeps a hub's neighbours
    spread over many rows and tasks instead of one in-memory object.
    """
    u = simple_edges(edges)
    return u.select(F.col("a").alias("id"), F.col("b").alias("nb")).unionByName(
        u.select(F.col("b").alias("id"), F.col("a").alias("nb")))


def endpoint_ids(edges: DataFrame) -> DataFrame:
    """vertices = distinct senders union distinct receivers, as ``(id)``.

    A missing end (contract creation) is no vertex."""
    return (
        edges.select(F.col("src").alias("id"))
        .unionByName(edges.select(F.col("dst").alias("id")))
        .filter(F.col("id").isNotNull())
        .distinct()
    )


def vertex_ids(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """B3 vertex completion: given vertices (if any) plus every edge endpoint."""
    ends = endpoint_ids(edges)
    if vertices is None:
        return ends
    return vertices.select("id").unionByName(ends).distinct()
