"""Helpers shared by the operators: shipping this package to the workers, lineage cuts,
and connected components over links found by the duplicate operators."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph.session import checkpoint_dir, scratch_path

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once a Spark application).

    Functions are then imported by the workers rather than pickled, so what a worker has
    loaded (vocabularies, word memos) lives across the tasks it runs.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "txgraph")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    path = os.path.join(tempfile.mkdtemp(prefix="txgraph-ship-"), "txgraph_llm_pkg.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    A columnar, compressed written table: lost executors cost no recomputation, and it
    takes less disk than a checkpoint of the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_parts(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    checkpoint_dir(spark)
    return scratch_path(spark, name)


def slices(batch_bytes: int, sizes) -> list[tuple[int, int]]:
    """Cut consecutive rows into runs of about ``batch_bytes`` (a single longer row is its
    own run); returns (start, end) index pairs."""
    out, start, acc = [], 0, 0
    for i, s in enumerate(sizes):
        if acc and acc + s > batch_bytes:
            out.append((start, i))
            start, acc = i, 0
        acc += s
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out


def lower_ascii(c):
    """A-Z to a-z and nothing else, as a column expression."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
