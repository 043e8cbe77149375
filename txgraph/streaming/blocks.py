"""Incremental block ingest (A10) with Structured Streaming.

The collector's loop "fetch the next block, merge its transactions into a map keyed by
hash" becomes a keyed streaming aggregate and a table that its changes are merged into:

* the stream turns a landing folder of v2 block files into transaction rows and rejected
  lines, from one parse (A3, ``sources.blocks.split_lines``);
* ``groupBy(hash)`` keeps each key's winner by E2 (``min(struct)``, combined map-side) in a
  RocksDB state store, whose changes go to the query's checkpoint folder. Update mode gives each
  trigger the keys it touched;
* ``foreachBatch`` appends the new winners as a run, and writes apart the keys whose earlier
  winner they replace (few: only blocks that land out of order repeat a hash). After ``COMPACT``
  runs or more, as many as the base has, the live rows become a new base: at most log2(T) bases in T
  triggers, together below twice the rows if triggers are alike. A commit row, written last, says what counts,
  so a trigger that is repeated after a failure overwrites its own run and no reader sees half.

Reading is a scan of the base and the runs since, minus the replaced keys, a small table that
Spark broadcasts: the history is not aggregated again. A lower block that lands later wins, also
after a restart. The driver's clock must not run backwards between triggers (a trigger's time
tells its own winners from earlier ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txgraph import schema as S
from txgraph.operators.sample import win_order
from txgraph.session import CLEANUP
from txgraph.sources.blocks import split_lines

COMPACT = 16
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Old states kept: a restart needs the last two; Spark's default of 100 keeps every rewrite.
_RETAIN, RETAIN = "spark.sql.streaming.minBatchesToRetain", "2"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
# The state holds every key's winner twice, on the executors and in the checkpoint folder.
_ZSTD = ("spark.sql.streaming.stateStore.rocksdb.compression", "spark.sql.streaming.stateStore.compression.codec")
_PARTS = "spark.sql.shuffle.partitions"
_ROW = ("src", "dst", "value")
_RUN = ("hash string, height bigint, pos bigint, src string, dst string, value bigint, "
        f"{S.CORRUPT} string, copies bigint")


def block_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None,
                 null_to: str = "keep") -> DataFrame:
    """Streaming frame ``(height, pos, hash, src, dst, value, _corrupt_record)`` of a landing
    folder: a row per transaction and one per line that is not a block."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return split_lines(reader.text(landing_dir), null_to)


def winners(rows: DataFrame) -> DataFrame:
    """``(hash, _corrupt_record, w, first, copies, now)``: per key the winner by E2 with the time
    of its trigger (``w.at``), the key's first trigger, its rows so far, and this trigger. Height and
    position are held once, as the order has them (``w._h``, ``-w._p``)."""
    timed = rows.withColumn("at", F.current_timestamp())
    return timed.groupBy("hash", S.CORRUPT).agg(
        F.min(F.struct(*win_order(), *_ROW, "at")).alias("w"),
        F.min("at").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("now", F.current_timestamp())


def _merge(out_dir: str, compact: int):
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = f"{out_dir}/runs/run={batch_id}"
        # rejected lines have no winner but a count, so theirs is always new
        new = (F.col("w.at") == F.col("now")) | F.col(S.CORRUPT).isNotNull()
        batch.filter(new).select("hash", F.col("w._h").alias("height"), (-F.col("w._p")).alias("pos"),
                                 *[f"w.{c}" for c in _ROW], S.CORRUPT, "copies",
                                 (F.col("first") < F.col("now")).alias("over")
                                 ).write.mode("overwrite").parquet(run, compression="zstd")
        spark.read.schema(f"{_RUN}, over boolean").parquet(run).filter("over").select(
            "hash", S.CORRUPT).write.mode("overwrite").parquet(f"{out_dir}/over/run={batch_id}")
        base = _committed(spark, out_dir)[1] if batch_id else -1
        # not before the runs since are as many as the base has: rewriting stays in proportion
        if batch_id - base >= max(compact, base + 1):
            _live(spark, out_dir, batch_id, base).drop("run", "over").write.mode("overwrite").parquet(
                f"{out_dir}/base/upto={batch_id}", compression="zstd")
            base = batch_id
        spark.createDataFrame([(batch_id, base)], "batch bigint, base bigint").coalesce(1).write.mode(
            "overwrite").parquet(f"{out_dir}/commits/of={batch_id}")
    return merge


def _committed(spark: SparkSession, out_dir: str) -> tuple[int, int]:
    """The last committed trigger and the last run in its base (one row)."""
    row = spark.read.schema("batch bigint, base bigint").parquet(f"{out_dir}/commits").agg(
        F.max(F.struct("batch", "base")).alias("c")).first()
    return (row.c.batch, row.c.base) if row.c else (-1, -1)


def _live(spark: SparkSession, out_dir: str, batch: int, base: int) -> DataFrame:
    """All rows that no later run replaced."""
    since = (F.col("run") > base) & (F.col("run") <= batch)
    rows = spark.read.schema(f"{_RUN}, over boolean, run bigint").parquet(f"{out_dir}/runs").filter(since)
    if base >= 0:
        old = spark.read.schema(_RUN).parquet(f"{out_dir}/base/upto={base}")
        rows = rows.unionByName(old.withColumn("run", F.lit(base)).withColumn("over", F.lit(False)))
    over = spark.read.schema(f"hash string, {S.CORRUPT} string, run bigint").parquet(f"{out_dir}/over").filter(since).select(
        F.col("hash").alias("h"), F.col(S.CORRUPT).alias("c"), F.col("run").alias("by"))
    return rows.join(over, rows["hash"].eqNullSafe(over["h"]) & rows[S.CORRUPT].eqNullSafe(over["c"])
                     & (rows["run"] < over["by"]), "left_anti")


def stream_blocks(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint: str,
                  available_now: bool = True, max_files_per_trigger: int | None = None,
                  null_to: str = "keep", compact: int = COMPACT) -> StreamingQuery:
    """Start the ingest into the table at ``out_dir`` (read it with :func:`read_stream_blocks`).

    ``available_now=True`` processes what has landed and stops (batch-like runs);
    ``False`` keeps polling the folder. The state store's settings are set for this query only.
    """
    rows = block_stream(spark, landing_dir, max_files_per_trigger, null_to)
    writer = winners(rows).writeStream.foreachBatch(_merge(out_dir, compact)).option(
        "checkpointLocation", checkpoint).outputMode("update")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    own = {_PROVIDER: _ROCKSDB, _RETAIN: RETAIN, _CHANGELOG: "true", CLEANUP: "true"} | dict.fromkeys(_ZSTD, "zstd")
    if max_files_per_trigger:
        # each part of the state is opened and committed in every trigger, however few rows it gets
        own[_PARTS] = str(min(int(spark.conf.get(_PARTS)), 2 * spark.sparkContext.defaultParallelism))
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _table(spark: SparkSession, out_dir: str) -> DataFrame:
    return _live(spark, out_dir, *_committed(spark, out_dir))


def read_stream_blocks(spark: SparkSession, out_dir: str) -> DataFrame:
    """The ingested transactions ``(height, pos, hash, src, dst, value)``, one row per hash by E2."""
    return _table(spark, out_dir).filter(F.col(S.CORRUPT).isNull()).select(
        "height", "pos", "hash", "src", "dst", "value")


def stream_rejects(spark: SparkSession, out_dir: str) -> DataFrame:
    """The landed lines that were not blocks, as ``(_corrupt_record, copies)``."""
    return _table(spark, out_dir).filter(F.col(S.CORRUPT).isNotNull()).select(S.CORRUPT, "copies")
