"""Graph construction.

The loaded tables are ``vertices(address)`` and ``edges(hash, src, dst, value)`` with
address strings; algorithms work on ``bigint`` ids. ``TxGraph`` pairs the two frames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txgraph.operators.views import whole_edges
from txgraph.session import cut, cut_table


@dataclass(frozen=True)
class TxGraph:
    """A directed multigraph: ``vertices(id, ...)`` and ``edges(src, dst, value)``."""

    vertices: DataFrame
    edges: DataFrame


def assign_ids(addresses: DataFrame, col: str = "address", partitions: int | None = None) -> DataFrame:
    """B1: distinct addresses -> dense ids ``0..n-1`` in address order: ``(address, vid)``.

    Range-partition and sort the distinct addresses, tag rows with
    ``monotonically_increasing_id`` (partition index in the high bits), checkpoint,
    then add each partition's offset: a running sum over the per-partition counts,
    a table with one row per partition (a proven bound, so it is broadcast).
    No global single-partition window is involved.
    """
    spark = addresses.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = cut(
        addresses.select(F.col(col).alias("address")).distinct()
        .repartitionByRange(n, "address")
        .sortWithinPartitions("address")
        .withColumn("mono", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("mono", 33))
    )
    counts = tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(
        "part",
        (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("offset"),
    )
    return tagged.join(F.broadcast(offsets), "part").select(
        "address",
        (F.coalesce("offset", F.lit(0)) + F.col("mono") - F.shiftleft("part", 33))
        .cast("bigint").alias("vid"),
    )


def encode_edges(edges: DataFrame, ids: DataFrame, on_missing: str = "error") -> DataFrame:
    """B2: replace address endpoints by ids: ``(src, dst, value)`` as bigints.

    ``on_missing``: ``'error'`` fails the job on an endpoint without id (as the source
    does), ``'drop'`` drops such edges, ``'add'`` gives such endpoints the next free ids
    (see :func:`extend_ids`). A row with a missing end is no edge and is left out. ``ids`` should
    be a written table; the joins are plain ones, which the adaptive skew split deals.
    """
    if on_missing not in ("error", "drop", "add"):
        raise ValueError("on_missing must be 'error', 'drop' or 'add'")
    if on_missing == "add":
        ids = extend_ids(edges, ids)
    s = ids.select(F.col("address").alias("src"), F.col("vid").alias("src_id"))
    d = ids.select(F.col("address").alias("dst"), F.col("vid").alias("dst_id"))
    how = "inner" if on_missing == "drop" else "left"
    j = whole_edges(edges).join(s, "src", how).join(d, "dst", how)
    if on_missing == "error":
        missing = F.col("src_id").isNull() | F.col("dst_id").isNull()
        guard = F.when(missing, F.raise_error(F.lit("edge endpoint without a vertex id")))
        j = j.withColumn("src_id", F.coalesce(guard.cast("bigint"), F.col("src_id")))
    return j.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "value")


def extend_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids(address, vid)`` and, after the largest id, the endpoints it lacks, in address
    order."""
    ends = (edges.select(F.col("src").alias("address"))
            .unionByName(edges.select(F.col("dst").alias("address")))
            .filter(F.col("address").isNotNull()).distinct())
    last = ids.agg(F.coalesce(F.max("vid"), F.lit(-1).cast("bigint")).alias("m")).first()["m"]
    more = assign_ids(ends.join(ids.select("address"), "address", "left_anti"))
    return ids.select("address", "vid").unionByName(
        more.select("address", (F.col("vid") + (last + 1)).alias("vid")))


def build_graph(vertices: DataFrame, edges: DataFrame, on_missing: str = "error") -> TxGraph:
    """B1 + B2 + B3: address tables -> ``TxGraph`` on dense ids.

    ``vertices(address)``, ``edges(src, dst, value)`` with address strings.
    """
    ids = cut_table(assign_ids(vertices))
    if on_missing == "add":
        ids, on_missing = cut_table(extend_ids(edges, ids)), "error"
    return TxGraph(ids.select(F.col("vid").alias("id"), "address"),
                   encode_edges(edges, ids, on_missing))


def graph_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(vertices, edges)``."""
    from txgraph.plans.report import one_row

    return one_row(vertices.agg(F.count(F.lit(1)).alias("vertices")),
                   whole_edges(edges).agg(F.count(F.lit(1)).alias("edges")))


def induced_edges(edges: DataFrame, keep: DataFrame, both_ends: bool = True) -> DataFrame:
    """Edges whose ends are in ``keep(id)``; ``both_ends=False`` checks the source only
    (enough when both ends are known to share membership, e.g. a component).
    The kept set is never collected: it is written once, and Spark broadcasts it when it is
    small. Otherwise the semi-joins are shuffled; the adaptive skew split deals a hub's rows.
    """
    keep = cut_table(keep.select("id").distinct())
    out = whole_edges(edges)
    for end in ("src", "dst") if both_ends else ("src",):
        out = out.join(keep.select(F.col("id").alias(end)), end, "left_semi")
    return out.select(*edges.columns)


def induced_subgraph(graph: TxGraph, keep: DataFrame) -> TxGraph:
    """Vertices in ``keep(id)`` and the edges among them."""
    return TxGraph(graph.vertices.join(keep.select("id"), "id", "left_semi"),
                   induced_edges(graph.edges, keep))
