"""GEXF export (A9) as a distributed text job.

The document is a set of lines in five sections: 0 header and ``<nodes>``, 1 one
``<node>`` per vertex, 2 ``</nodes><edges>``, 3 one ``<edge>`` per edge, 4 the footer.
``write_gexf`` range-partitions by ``(section, key)`` and sorts within partitions, so
the part files concatenated in name order form the document; no line passes through
the driver. Attribute values are XML-escaped (the source does not escape).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph.functions.scalars import XML_ESCAPES, xml_escape
from txgraph.operators.views import whole_edges
from txgraph.session import cut_table

# The namespace and version of the document frame.
GEXF_NS = "http://www.gexf.net/1.2draft"
GEXF_VERSION = "1.3"


def _header(title: str, date: str, creator: str) -> list[str]:
    esc = dict(XML_ESCAPES)

    def x(s: str) -> str:
        return "".join(esc.get(ch, ch) for ch in s)

    return [
        '<?xml version="1.0" encoding="UTF-8"?>',
        f'<gexf xmlns="{GEXF_NS}" version="{GEXF_VERSION}">',
        f'<meta lastmodifieddate="{x(date)}">',
        f"<creator>{x(creator)}</creator>",
        f"<description>{x(title)}</description>",
        "</meta>",
        '<graph mode="static" defaultedgetype="directed">',
        "<nodes>",
    ]


_FOOTER = ["</edges>", "</graph>", "</gexf>"]


def node_lines(vertices: DataFrame, label: str = "label") -> DataFrame:
    """``(section, k1, k2, k3, line)`` for every vertex ``(id, label)``."""
    return vertices.select(
        F.lit(1).alias("section"), F.col("id").cast("bigint").alias("k1"),
        F.lit(None).cast("bigint").alias("k2"), F.lit(None).cast("string").alias("k3"),
        F.concat(F.lit('<node id="'), xml_escape("id"), F.lit('" label="'),
                 xml_escape(F.coalesce(F.col(label).cast("string"), F.lit(""))), F.lit('" />'))
        .alias("line"),
    )


def edge_lines(edges: DataFrame, label: str = "value") -> DataFrame:
    """``(section, k1, k2, k3, line)`` for every edge ``(src, dst, label)`` with both ends."""
    return whole_edges(edges).select(
        F.lit(3).alias("section"), F.col("src").cast("bigint").alias("k1"),
        F.col("dst").cast("bigint").alias("k2"), F.col(label).cast("string").alias("k3"),
        F.concat(F.lit('<edge source="'), xml_escape("src"), F.lit('" target="'),
                 xml_escape("dst"), F.lit('" label="'),
                 xml_escape(F.coalesce(F.col(label).cast("string"), F.lit(""))), F.lit('" />'))
        .alias("line"),
    )


def gexf_lines(vertices: DataFrame, edges: DataFrame, title: str = "transaction graph",
               date: str = "1970-01-01", creator: str = "txgraph") -> DataFrame:
    """All document lines with their ordering keys ``(section, k1, k2, k3, line)``.

    The frame lines are a handful of literal rows; ``date`` is a parameter, not a
    clock reading, so the output is deterministic.
    """
    spark = vertices.sparkSession
    fixed = ([(0, i, None, None, s) for i, s in enumerate(_header(title, date, creator))]
             + [(2, 0, None, None, "</nodes>"), (2, 1, None, None, "<edges>")]
             + [(4, i, None, None, s) for i, s in enumerate(_FOOTER)])
    frame = spark.createDataFrame(
        fixed, "section int, k1 bigint, k2 bigint, k3 string, line string")
    return frame.unionByName(node_lines(vertices)).unionByName(edge_lines(edges))


def write_gexf(vertices: DataFrame, edges: DataFrame, path: str, partitions: int | None = None,
               **meta: str) -> None:
    """Write the document as ordered part files under ``path`` (concatenate in name order)."""
    lines = gexf_lines(vertices, edges, **meta)
    n = partitions or int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, "section", "k1", "k2", "k3")
     .sortWithinPartitions("section", "k1", "k2", "k3")
     .select("line").write.mode("errorifexists").text(path))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(part, start, row, lines, first)``: of every split of the written part files its number of
    lines and the number of its first line in the document. One row a split, so their running sum
    is small; ``row`` is the first line's number as the scan counts them."""
    from pyspark.sql import Window

    splits = _scan(spark, path).groupBy("part", "start").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("lines"))
    before = Window.orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """``(n, line)``: the written document's lines, numbered from 0, read as rows."""
    at = cut_table(manifest(spark, path))       # one row a split
    return _scan(spark, path).join(
        F.broadcast(at.withColumnRenamed("row", "row0")), ["part", "start"]).select(
        (F.col("first") + F.col("row") - F.col("row0")).alias("n"), "line")
