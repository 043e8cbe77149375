"""Transaction graphs derived from the TPC-H-like test tables.

``tx`` has one row per lineitem (every lineitem has its order):

* ``hash``   ``l_orderkey-l_partkey-l_suppkey-l_linenumber-cents-yyyymmdd(l_shipdate)``
  (unique; ``(l_orderkey, l_linenumber)`` alone is not);
* ``src``    ``o_custkey`` (sender), ``dst`` ``l_partkey`` (receiver): customer and part
  ids share one id space on purpose, which yields reciprocal pairs and self-loops;
* ``value``  ``round(l_extendedprice * 100)`` as bigint (cents);
* ``height`` days from 1995-01-01 to ``o_orderdate`` (the "block").

``monthly`` has the same rows with addresses scoped to the month of the order on both
ends (``id = month_no * 10,000,000 + key``, ``month_no = year * 12 + month``), so a month
never links to another: a whole-table graph with many components. Every ``*_SQL``
string is the DuckDB text of the same table, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The epoch of the height column and the id space of a month.
HEIGHT_EPOCH = "1995-01-01"
MONTH_SPACE = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _yyyymmdd(c: str):
    # Arithmetic instead of date_format: no per-row formatter (4-digit years).
    d = F.to_date(c)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def _tx(spark: SparkSession, sf_dir: str, monthly: bool) -> DataFrame:
    # what the join shuffles are the numbers that come of it, which compress better than
    # the doubles and timestamps they are made of
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        _yyyymmdd("l_shipdate").alias("shipped"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    base = ((F.year("day") * 12 + F.month("day")).cast("bigint") * MONTH_SPACE
            if monthly else F.lit(0).cast("bigint"))
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    F.col("cents").cast("string"), F.col("shipped").cast("string")).alias("hash"),
        (base + F.col("o_custkey")).alias("src"),
        (base + F.col("l_partkey")).alias("dst"),
        F.col("cents").alias("value"),
        F.datediff("day", F.lit(HEIGHT_EPOCH).cast("date")).cast("bigint").alias("height"),
        "l_orderkey",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx(hash, src, dst, value, height)``: the dense transaction table."""
    return _tx(spark, sf_dir, monthly=False).drop("l_orderkey")


def keyed_transactions(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All rows of :func:`transactions` in two parts, with ``block``, the text before a hash's first
    ``-``. In the first part, which has the orders with keys from 0 on, that is the order's key, by which the join
    has dealt the rows: grouping by it needs no second shuffle. The hash of an order below 0 begins
    with ``-``; the second part has those."""
    tx = _tx(spark, sf_dir, monthly=False)
    return [tx.filter("l_orderkey >= 0").withColumnRenamed("l_orderkey", "block"),
            tx.filter("l_orderkey < 0").drop("l_orderkey").withColumn("block", F.substring_index("hash", "-", 1))]


def monthly_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions with month-scoped addresses (many components)."""
    return _tx(spark, sf_dir, monthly=True).drop("l_orderkey")


def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("src", "dst", "value")


def monthly_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_transactions(spark, sf_dir).select("src", "dst", "value")


# --- DuckDB text of the same tables (oracle side) ---------------------------------

_TX_SELECT = """
SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_partkey AS VARCHAR) || '-'
       || CAST(l.l_suppkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-'
       || CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS VARCHAR) || '-'
       || strftime(l.l_shipdate, '%Y%m%d') AS hash,
       o.o_custkey AS src,
       l.l_partkey AS dst,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) AS value,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) AS BIGINT) AS height
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

TX_SQL = _TX_SELECT
MONTHLY_TX_SQL = f"""
SELECT hash, m + src AS src, m + dst AS dst, value, height FROM (
  SELECT *, (year(d) * 12 + month(d)) * {MONTH_SPACE}::BIGINT AS m FROM (
    SELECT *, DATE '1995-01-01' + CAST(height AS INTEGER) AS d FROM ({_TX_SELECT})))
"""
