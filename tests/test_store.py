"""Stored layouts: what is read, what stays, and the same rows as the plain operators."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from txgraph.operators.sample import snowball_sample
from txgraph.session import scratch_path
from txgraph.sources import gexf as GX
from txgraph.sources import store as ST


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tx(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("h"), "id").alias("hash"), (F.col("id") % 37).alias("src"),
        F.when(F.col("id") % 11 != 0, F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 53)).cast("bigint").alias("dst"),
        F.col("id").alias("value"), F.when(F.col("id") % 97 != 0, F.col("id") % 900).alias("height"))
    return rows


def test_range_reads_its_bands_only(spark, tx):
    path = scratch_path(spark, "bands")
    ST.write_tx_table(tx, path, band=50)
    got = ST.read_tx_range(spark, path, 120, 260, band=50)
    assert "PartitionFilters: [isnotnull(band" in _plan(got)
    files = {r[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert {f.split("band=")[1].split("/")[0] for f in files} == {"2", "3", "4", "5"}
    want = tx.filter(F.col("height").between(120, 260))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hop_reads_its_buckets_only(spark, tx):
    path = scratch_path(spark, "inc")
    ST.write_incidence(tx, path, buckets=16)
    some = spark.createDataFrame([(5,), (17,), (17,), (4711,)], "address bigint")
    got = ST.read_incidence(spark, path, some, buckets=16)
    pruned = _plan(got).split("PartitionFilters: [")[1].split("]")[0]
    buckets = {r[0] for r in some.select(ST.bucket_of("address", 16)).distinct().collect()}
    assert "bucket" in pruned and all(str(k) in pruned for k in buckets) and len(buckets) <= 3
    want = tx.filter(F.col("src").isin(5, 17) | F.col("dst").isin(5, 17))
    assert sorted(r.hash for r in got.select("hash").distinct().collect()) == sorted(r.hash for r in want.collect())
    assert ST.read_incidence(spark, path, some.limit(0), buckets=16).count() == 0
    plain = snowball_sample(tx, 100, 3, 4, 2)
    indexed = snowball_sample(tx, 100, 3, 4, 2, incident=lambda a: ST.read_incidence(spark, path, a, 16))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, indexed.collect()), key=repr)


def test_ids_stay_over_loads(spark):
    ids = ST.IdDictionary(spark, f"ids_{uuid.uuid4().hex}", scratch_path(spark, "ids"), buckets=4)
    assert ids.table().count() == 0
    assert ids.load(spark.createDataFrame([("b",), ("d",), ("b",), (None,)], "address string")) == 2
    first = {r.address: r.vid for r in ids.table().collect()}
    assert first == {"b": 0, "d": 1}
    e = spark.createDataFrame([("a", "b", 1), ("d", "c", 2), ("d", None, 3), ("b", "b", 4)],
                              "src string, dst string, value bigint")
    got = ids.encode(e)
    after = {r.address: r.vid for r in ids.table().collect()}
    assert after == {"b": 0, "d": 1, "a": 2, "c": 3}
    assert sorted(map(tuple, got.collect())) == [(0, 0, 4), (1, 3, 2), (2, 0, 1)]
    assert ids.load(e, "src") == 4 and ids.load(e.limit(0), "src") == 4
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        join = e.repartition(4).select(F.col("src").alias("address")).join(ids.table(), "address")
        plan = _plan(join)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    side = plan[plan.rindex("Sort"):]
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan and side


def test_document_is_read_in_splits(spark):
    path = scratch_path(spark, "gexf")
    v = spark.range(500).withColumn("label", F.col("id").cast("string"))
    e = spark.range(900).select((F.col("id") % 500).alias("src"), F.when(F.col("id") % 9 != 0, F.lit(3)).cast("bigint").alias("dst"),
                                F.col("id").alias("value"))
    GX.write_gexf(v, e, path, partitions=3, date="2020-05-01")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = [r.line for r in GX.read_document(spark, path).orderBy("n").collect()]
        n = [r.n for r in GX.read_document(spark, path).select("n").orderBy("n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    local = path.replace("file:", "")
    want = "".join(open(f"{local}/{f}").read() for f in sorted(os.listdir(local)) if f.startswith("part-")).splitlines()
    assert got == want and n == list(range(len(want))) and len(want) == 13 + 500 + 800
