"""Session helpers: a local session for tests and benches, and lineage cuts.

Iterative operators (components, label propagation, snowball sampling) cut their
lineage every round with a *reliable* ``checkpoint()`` into the folder the cluster
names in ``spark.checkpoint.dir``. That folder must be shared storage on a cluster;
only a local session (tests, bench) gets a private default when it is unset.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "txgraph") -> SparkSession:
    """Session for tests and the bench: local master, AQE on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="txgraph-ckpt-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, wiring it into the context if needed.

    Order: a folder already set on the context; else ``spark.checkpoint.dir`` from
    the session conf; else a folder in the session's warehouse, which all executors share.
    A machine-local temporary folder is never chosen here (``local_session`` sets one, for
    tests and the bench on one machine). Set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` on the cluster, so that the states of
    past rounds are deleted once nothing refers to them.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no context
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_txgraph_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and cut its lineage with a reliable checkpoint.

    The data lands in the shared checkpoint folder, so a lost executor does not force
    recomputation of earlier rounds. ``localCheckpoint`` is never used.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_table(df: DataFrame, name: str = "table") -> DataFrame:
    """As :func:`cut`, but a Parquet table in the shared folder, read back: compressed, columnar,
    and of a size that Spark knows, so that small ones are broadcast in joins and large ones
    are shuffled plainly, which lets the adaptive skew split deal hot keys."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Writes started in here delete their shuffle files as they end. Otherwise those stay until the
    driver happens to collect its garbage, beside the tables that were made of them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`scratch_path` that nothing reads again. A Spark Connect session, which
    has no file system of its own, leaves it."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - as in checkpoint_dir
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
