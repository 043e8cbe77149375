"""CSV sources and sinks.

The analysis input is two CSV folders with headers: vertices ``address`` and edges
``hash,in,out,value`` (``in`` = sender = source, ``out`` = receiver = destination).
Schemas are explicit: no inference pass, no numeric guess for an all-digit address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph import schema as S


def _glob(path: str) -> str:
    # The folder string is used as a prefix: "data/nodes" also matches "data/nodes-2".
    return path + "*"


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """A1: every CSV file under the path prefix, header row, distinct rows: ``(address)``."""
    return (
        spark.read.schema(S.VERTEX_CSV).option("header", True).option("mode", "FAILFAST")
        .csv(_glob(path)).distinct()
    )


def read_edges(spark: SparkSession, path: str, keep_hash: bool = False) -> DataFrame:
    """A2: edge CSVs, distinct on the whole row, then the hash dropped:
    ``(src, dst, value)`` with address strings. Two transactions between the same
    pair stay two parallel edges (their hashes differ)."""
    rows = (
        spark.read.schema(S.EDGE_CSV).option("header", True).option("mode", "FAILFAST")
        .csv(_glob(path)).distinct()
    )
    out = rows.select(*(["hash"] if keep_hash else []), F.col("in").alias("src"),
                      F.col("out").alias("dst"), "value")
    return out


def write_graph_csv(vertices: DataFrame, edges: DataFrame, vertex_dir: str, edge_dir: str,
                    mode: str = "errorifexists") -> bool:
    """Write both tables with their headers, only if **both** are non-empty.

    ``vertices(address)``; ``edges(hash, src, dst, value)`` written as
    ``hash,in,out,value``. Returns whether anything was written.
    """
    # vertices are often derived from the edges: the cheaper test comes first
    if edges.isEmpty() or vertices.isEmpty():
        return False
    vertices.select("address").write.mode(mode).option("header", True).csv(vertex_dir)
    edges.select("hash", F.col("src").alias("in"), F.col("dst").alias("out"), "value") \
        .write.mode(mode).option("header", True).csv(edge_dir)
    return True


def write_rows(rows: DataFrame, directory: str, sep: str = ",", header: bool = True,
               mode: str = "append") -> None:
    """Generic row sink: append rows with a separator and optional header.

    Values are quoted/escaped by the CSV writer when needed (the source writes them
    raw), so a separator inside a value cannot shift columns.
    """
    rows.write.mode(mode).option("sep", sep).option("header", header).csv(directory)
