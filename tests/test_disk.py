"""What the ingest queries leave on disk beside each other."""

import os
import time

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffles(spark):
    """a step's shuffle files go as its table is written, not when the driver collects its garbage."""
    from txgraph.session import cut_table

    rows = spark.range(1000).repartition(3, "id")
    before = _shuffle_files(spark)
    rows.write.format("noop").mode("overwrite").save()
    plain = _shuffle_files(spark) - before
    assert plain                       # what any other action leaves
    out = cut_table(rows)
    for _ in range(50):                # they are removed beside what the driver does
        if not _shuffle_files(spark) - before - plain:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before - plain
    assert out.count() == 1000 and rows.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _orders(spark, path, keys):
    (spark.createDataFrame([(k, 7, "1995-01-0%d" % (i % 3 + 1)) for i, k in enumerate(keys)],
                           "o_orderkey bigint, o_custkey bigint, o_orderdate string")
     .withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{path}/orders.parquet"))
    (spark.createDataFrame([(k, p, 1, p, float(k % 5 + p), "1995-02-01") for k in set(keys) for p in range(3)],
                           "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                           "l_extendedprice double, l_shipdate string")
     .withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{path}/lineitem.parquet"))
    return str(path)


def test_orders_are_grouped_where_they_are_joined(spark, tmp_path):
    """no second shuffle of the transactions; lines as from hashes alone, for odd keys, too (an
    order twice, on two dates; keys below 0)."""
    from txgraph.plans import catalog
    from txgraph.plans import fixtures as fx
    from txgraph.plans import payloads as P

    d = _orders(spark, tmp_path, [0, 1, 1, 2, 3, -1, -2, -2, 12, 120])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for lines in (P.hard_v2_lines, P.v2_blocks):
            got = catalog._by_order(spark, d, lines)
            plan = got._jdf.queryExecution().executedPlan().toString()
            own, rest = (lines(tx)._jdf.queryExecution().executedPlan().toString()
                         for tx in fx.keyed_transactions(spark, d))
            assert own.count("Exchange") == 2 and rest.count("Exchange") == 3, plan
            assert sorted(r[0] for r in got.collect()) == sorted(
                r[0] for r in lines(fx.transactions(spark, d)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hard_lines_go_once_they_are_ingested(spark, monkeypatch):
    """the landing folder is gone, the rows are not."""
    from txgraph.plans import catalog

    made, at = [], catalog.scratch_path
    monkeypatch.setattr(catalog, "scratch_path", lambda *a: made.append(at(*a)) or made[-1])
    rows = catalog.QUERIES["hard_ingest"](spark, SF)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert rows.count() == catalog.fx.transactions(spark, SF).count()


def test_dedup_shuffles_height_and_position_once(spark):
    """they are in the order; types and missing values come back as they were."""
    from txgraph.operators.sample import dedup_last_wins

    kinds = "hash string, height int, pos %s, src string, value bigint"
    for kind in ("bigint", "smallint", "double"):
        rows = spark.createDataFrame(
            [("a", 3, 1, "s", 1), ("a", 3, 2, None, 2), ("a", 4, 9, "s", 3), ("b", None, 1, "s", 4),
             ("b", None, None, "s", 5), ("c", 0, None, "s", None)], kinds % "bigint").withColumn(
                 "pos", F.col("pos").cast(kind))
        out = dedup_last_wins(rows)
        assert out.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(tuple, out.collect())) == [("a", 3, 2, None, 2), ("b", None, 1, "s", 4), ("c", 0, None, "s", None)]
    plan = dedup_last_wins(rows.withColumn("pos", F.col("pos").cast("bigint")))._jdf.queryExecution().analyzed().toString()
    struct = plan[plan.index("min(struct("):plan.index(" AS w#")]
    assert struct.count("height#") == 2 and struct.count("pos#") == 2    # missing or not, and the value


def test_shifted_copies_lie_in_one_task(spark, monkeypatch):
    """both copies of a transaction are combined before the shuffle by hash."""
    from txgraph.plans import catalog

    seen, dedup = [], catalog.SM.dedup_last_wins
    monkeypatch.setattr(catalog.SM, "dedup_last_wins", lambda rows: seen.append(rows) or dedup(rows))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = catalog.QUERIES["dedup_last_wins"](spark, SF)
        copies = seen[0].withColumn("task", F.spark_partition_id()).groupBy("hash").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"))
        n = catalog.fx.transactions(spark, SF).count()
        assert [tuple(r) for r in copies.groupBy("n", "tasks").count().collect()] == [(2, 1, n)]
        assert out.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_graph_of_the_hard_rows_writes_what_it_reads(spark, monkeypatch):
    """hashes, heights and positions are not written again beside the ingested table."""
    from txgraph.plans import catalog

    seen, cut_table = [], catalog.cut_table
    monkeypatch.setattr(catalog, "cut_table", lambda df: seen.append(df.columns) or cut_table(df))
    assert catalog.QUERIES["hard_graph_edges"](spark, SF).columns == ["src", "dst", "value"]
    assert seen == [["src", "dst", "value"]]


def _land(path, files):
    for i in range(files):
        os.makedirs(f"{path}/in", exist_ok=True)
        with open(f"{path}/in/{i}.json", "w") as f:
            f.write('{"result":{"number":"0x%x","transactions":[{"hash":"0x%d","from":"0x1","to":"0x2","value":"0x5"},'
                    '{"hash":"0xaa","from":"0x1","to":"0x%d","value":"0x6"}]}}\n' % (9 - i, i, i))


def _exists(spark, path):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_stream_state_holds_a_row_once(spark, tmp_path, monkeypatch):
    """no height, position or time twice, compressed on the executors and in the checkpoint folder, and
    no shuffle files of past triggers."""
    from txgraph.streaming import blocks

    seen, merge = [], blocks._merge

    def spied(*a):
        def each(batch, batch_id):
            conf = batch.sparkSession.conf
            seen.append((batch.schema["w"].dataType.fieldNames(), *(conf.get(f"spark.sql.streaming.stateStore.{k}", None)
                                                                    for k in ("rocksdb.compression", "compression.codec"))))
            merge(*a)(batch, batch_id)
        return each

    monkeypatch.setattr(blocks, "_merge", spied)
    _land(tmp_path, 3)
    before = _shuffle_files(spark)
    blocks.stream_blocks(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state",
                         max_files_per_trigger=1).awaitTermination()
    assert seen == [(["_hn", "_h", "_pn", "_p", "src", "dst", "value", "at"], "zstd", "zstd")] * 3
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    rows = blocks.read_stream_blocks(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, rows.collect())) == [
        (7, 0, "2", "1", "2", 5), (7, 1, "aa", "1", "2", 6), (8, 0, "1", "1", "2", 5), (9, 0, "0", "1", "2", 5)]
    assert spark.conf.get("spark.sql.streaming.stateStore.compression.codec") == "lz4"


def test_stream_queries_keep_only_their_table(spark, monkeypatch):
    """landed lines and state go when the stream has ended."""
    from txgraph.plans import catalog

    made, at = [], catalog.scratch_path
    monkeypatch.setattr(catalog, "scratch_path", lambda *a: made.append(at(*a)) or made[-1])
    for query in ("stream_blocks", "hard_stream"):
        made.clear()
        rows = catalog.QUERIES[query](spark, SF)
        base, *lines = made
        assert not any(_exists(spark, p) for p in (f"{base}/landing", f"{base}/state", *lines))
        assert _exists(spark, f"{base}/out/runs")
        assert rows.count() == catalog.fx.transactions(spark, SF).count()


def test_small_triggers_open_few_parts_of_the_state(spark, tmp_path):
    """a trigger of a few files does not open and commit as many parts as the largest shuffle has."""
    from txgraph.streaming.blocks import read_stream_blocks, stream_blocks

    _land(tmp_path, 2)
    few, parts = 2 * spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", few + 5)
    try:
        for files, n in ((None, few + 5), (1, few)):
            at = f"{tmp_path}/{files}"
            stream_blocks(spark, f"{tmp_path}/in", f"{at}/out", f"{at}/state",
                          max_files_per_trigger=files).awaitTermination()
            assert len([p for p in os.listdir(f"{at}/state/state/0") if p.isdigit()]) == n
            assert read_stream_blocks(spark, f"{at}/out").count() == 3
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(few + 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
