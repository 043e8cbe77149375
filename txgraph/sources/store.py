"""Stored layouts of the transaction table that later jobs read in part.

* ``write_tx_table`` / ``read_tx_range``: a table in bands of heights (B11). A range of blocks
  prunes to its bands, so a sample reads in proportion to its range.
* ``write_incidence`` / ``read_incidence``: rows by address, in buckets of addresses (B13). A hop
  names the buckets of its frontier and reads only those.
* ``IdDictionary``: an append-only table of address ids (B1, B2), bucketed by address. Ids stay
  when more addresses are loaded, and joins with it shuffle the other side only.

Rows are laid out by ranges that go on in the hash, so one block or one address holding a third of
all rows is written by many tasks, into as many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txgraph.operators.build import assign_ids
from txgraph.operators.views import whole_edges

TX = T.StructType([T.StructField(n, t) for n, t in (
    ("hash", T.StringType()), ("src", T.LongType()), ("dst", T.LongType()), ("value", T.LongType()),
    ("height", T.LongType()))])


def _parts(spark: SparkSession, partitions: int | None) -> int:
    return partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_tx_table(tx: DataFrame, path: str, band: int = 100, partitions: int | None = None) -> None:
    """Write ``tx(hash, src, dst, value, height)`` in bands of ``band`` heights. Rows without a height
    lie in a band of their own, which no range reads."""
    n = _parts(tx.sparkSession, partitions)
    (tx.withColumn("band", F.floor(F.col("height") / band).cast("bigint"))
     .repartitionByRange(n, "height", "hash").sortWithinPartitions("height", "hash")
     .write.partitionBy("band").parquet(path, compression="zstd"))


def read_tx_range(spark: SparkSession, path: str, lo: int, hi: int, band: int = 100) -> DataFrame:
    """The rows with ``lo <= height <= hi``: of the stored bands only those that meet the range."""
    stored = spark.read.schema(T.StructType(TX.fields + [T.StructField("band", T.LongType())])).parquet(path)
    return stored.filter(F.col("band").between(lo // band, hi // band)
                         & F.col("height").between(lo, hi)).drop("band")


def bucket_of(address, buckets: int):
    """The bucket number of an address column."""
    return F.pmod(F.xxhash64(F.col(address) if isinstance(address, str) else address), F.lit(buckets))


def write_incidence(tx: DataFrame, path: str, buckets: int = 64, partitions: int | None = None) -> None:
    """Write a row per end of each transaction (one for a self-transfer; none for a missing end),
    by bucket of the end's address, each address's latest first."""
    sent = tx.select(F.col("src").alias("address"), *TX.fieldNames())
    got = tx.filter(~F.col("dst").eqNullSafe(F.col("src"))).select(F.col("dst").alias("address"), *TX.fieldNames())
    key = ["bucket", "address", F.desc("height"), "hash"]
    (sent.unionByName(got).filter(F.col("address").isNotNull())
     .withColumn("bucket", bucket_of("address", buckets))
     .repartitionByRange(_parts(tx.sparkSession, partitions), *key).sortWithinPartitions(*key)
     .write.partitionBy("bucket").parquet(path, compression="zstd"))


def read_incidence(spark: SparkSession, path: str, addresses: DataFrame, buckets: int = 64) -> DataFrame:
    """``(address, hash, src, dst, value, height)`` of the given ``(address)`` rows. The driver learns
    which buckets they lie in (``buckets`` numbers at most); the scan reads only those."""
    at = [r.b for r in addresses.select(bucket_of("address", buckets).alias("b")).distinct().collect()]
    fields = [T.StructField("address", T.LongType()), *TX.fields, T.StructField("bucket", T.LongType())]
    stored = spark.read.schema(T.StructType(fields)).parquet(path)
    return stored.filter(F.col("bucket").isin(at) if at else F.lit(False)).drop("bucket").join(
        addresses.select("address").distinct(), "address", "left_semi")


class IdDictionary:
    """Ids of addresses that stay: ``(address, vid)``, a table in the session's catalog bucketed by
    address, to which each load appends the addresses it brings. One load at a time."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or _parts(spark, None)

    def table(self) -> DataFrame:
        """``(address, vid)``."""
        if not self.spark.catalog.tableExists(self.name):
            return self.spark.createDataFrame([], "address string, vid bigint")
        return self.spark.table(self.name)

    def load(self, addresses: DataFrame, col: str = "address") -> int:
        """Give the addresses that have no id the next ones, in address order; returns the number of
        ids there are. Missing addresses get none."""
        have = self.table()
        last = have.agg(F.coalesce(F.max("vid"), F.lit(-1).cast("bigint")).alias("m")).first()["m"]
        named = addresses.select(F.col(col).cast("string").alias("address")).filter(
            F.col("address").isNotNull()).distinct()
        new = assign_ids(named.join(have, "address", "left_anti"))
        writer = (new.select("address", (F.col("vid") + (last + 1)).alias("vid"))
                  .repartition(self.buckets, "address")
                  .write.mode("append").bucketBy(self.buckets, "address").sortBy("address"))
        if self.path:
            writer = writer.option("path", self.path)
        writer.saveAsTable(self.name)
        return self.table().agg(F.max("vid")).first()[0] + 1 if last >= 0 or not self.table().isEmpty() else 0

    def encode(self, edges: DataFrame) -> DataFrame:
        """B2: ``(src, dst, value)`` as ids, after loading the ends that have none. Rows with a missing
        end are no edges. The dictionary is not shuffled."""
        e = whole_edges(edges)
        ends = e.select(F.col("src").alias("address")).unionByName(e.select(F.col("dst").alias("address")))
        self.load(ends)
        ids = self.table()
        x = e.join(ids.select(F.col("address").alias("src"), F.col("vid").alias("s")), "src").join(
            ids.select(F.col("address").alias("dst"), F.col("vid").alias("d")), "dst")
        return x.select(F.col("s").alias("src"), F.col("d").alias("dst"), "value")
