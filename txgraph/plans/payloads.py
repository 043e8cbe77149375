"""JSON payloads made from the transaction table, for the ingest operators.

They play the role of the collector's downloads. A "block" is one order: all its
lines share the order date (the height) and an order has a bounded number of lines,
so grouping a block into one document never gathers an unbounded group.
Addresses are the decimal ids, values are ``0x`` + lower-case hex (C8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.functions.hexval import long_to_hex


def _with_block(tx: DataFrame) -> DataFrame:
    return tx if "block" in tx.columns else tx.withColumn("block", F.substring_index("hash", "-", 1))


def v2_blocks(tx: DataFrame, *apart: str) -> DataFrame:
    """``(json)``: one v2 block document per order, transactions sorted by hash; rows that differ in
    the columns ``apart`` go into documents of their own."""
    items = F.struct(
        F.concat(F.lit("0x"), "hash").alias("hash"),
        F.concat(F.lit("0x"), F.col("src").cast("string")).alias("from"),
        F.concat(F.lit("0x"), F.col("dst").cast("string")).alias("to"),
        long_to_hex("value").alias("value"),
    )
    blocks = _with_block(tx).groupBy("block", "height", *apart).agg(
        F.sort_array(F.collect_list(items)).alias("transactions"))
    doc = F.struct(F.struct(long_to_hex("height").alias("number"), "transactions").alias("result"))
    return blocks.select(F.to_json(doc).alias("json"))


def v1_blocks(tx: DataFrame) -> DataFrame:
    """``(json)``: one v1 block document per order with its sorted transaction ids."""
    blocks = _with_block(tx).groupBy("block", "height").agg(
        F.sort_array(F.collect_list("hash")).alias("txids"))
    doc = F.struct(
        F.size("txids").alias("n_tx"), "txids",
        F.concat(F.lit("blk-"), "block").alias("hash"), "height")
    return blocks.select(F.to_json(doc).alias("json"))


def v1_transactions(tx: DataFrame) -> DataFrame:
    """``(json)``: one v1 transaction document per transaction."""
    doc = F.struct(
        F.col("height").alias("block_height"), "hash",
        F.array(F.col("src").cast("string"), F.col("dst").cast("string")).alias("addresses"),
        F.col("value").alias("total"),
        F.array(F.struct(F.lit(0).cast("bigint").alias("sequence"),
                         F.array(F.col("src").cast("string")).alias("addresses"))).alias("inputs"),
        F.array(F.struct(F.col("value").alias("value"),
                         F.array(F.col("dst").cast("string")).alias("addresses"))).alias("outputs"),
    )
    return tx.select(F.to_json(doc).alias("json"))


def address_refs(tx: DataFrame) -> DataFrame:
    """Incidence rows ``(address, block, tx_hash, tx_input_n, tx_output_n, value)``:
    the sender side has input 0, the receiver side output 0 (-1 for the other)."""
    t = _with_block(tx)
    snd = t.select(F.col("src").cast("string").alias("address"), "block",
                   F.col("hash").alias("tx_hash"), F.lit(0).alias("tx_input_n"),
                   F.lit(-1).alias("tx_output_n"), "value")
    rcv = t.select(F.col("dst").cast("string").alias("address"), "block",
                   F.col("hash").alias("tx_hash"), F.lit(-1).alias("tx_input_n"),
                   F.lit(0).alias("tx_output_n"), "value")
    return snd.unionByName(rcv)


def v1_addresses(tx: DataFrame) -> DataFrame:
    """``(json)``: one v1 address document per (address, block), a page of its
    transaction references sorted by (hash, input index)."""
    ref = F.struct("tx_hash", "tx_input_n", "tx_output_n", "value")
    pages = address_refs(tx).groupBy("address", "block").agg(
        F.sort_array(F.collect_list(ref)).alias("txrefs"))
    doc = F.struct("address", F.size("txrefs").cast("bigint").alias("n_tx"), "txrefs")
    return pages.select(F.to_json(doc).alias("json"))


def hard_v2_lines(tx: DataFrame) -> DataFrame:
    """``(value)``: block lines with all that ingest must cope with, derived from every row.

    Per order: its block, whose transactions with an even value have no receiver; a later
    block (height + 1) with the same hashes and value + 1; the same height again with the
    transactions repeated at later positions and value + 2; and a line cut off in the middle.
    """
    rows = _with_block(tx).groupBy("block").agg(
        F.collect_list(F.struct("height", "hash", "src", "dst", "value")).alias("rows"))
    heights = F.array_distinct(F.transform("rows", lambda r: r["height"]))
    # the lines of an order, made from one gathering of its rows

    def kind(k):
        return lambda h: F.struct(h.alias("height"), F.lit(k).alias("kind"))

    kinds = F.concat(F.transform(heights, kind(2)), F.transform(heights, kind(1)),
                     F.array(kind(0)(F.lit(None).cast("bigint"))))
    lines = rows.select("block", "rows", F.explode(kinds).alias("at")).select("block", "rows", "at.*")

    def item(r):
        return F.struct(
            F.concat(F.lit("0x"), r["hash"]).alias("hash"),
            F.concat(F.lit("0x"), r["src"].cast("string")).alias("from"),
            F.when(r["value"] % 2 != 0, F.concat(F.lit("0x"), r["dst"].cast("string"))).alias("to"),
            long_to_hex(r["value"] + F.col("kind")).alias("value"))

    own = F.filter("rows", lambda r: r["height"].eqNullSafe(F.col("height")))
    txs = F.sort_array(F.transform(own, item))
    doc = F.struct(F.struct(
        long_to_hex(F.col("height") + F.when(F.col("kind") == 1, 1).otherwise(0)).alias("number"),
        F.when(F.col("kind") == 2, F.concat("txs", "txs")).otherwise(F.col("txs")).alias("transactions")
    ).alias("result"))
    return lines.withColumn("txs", txs).select(F.when(
        F.col("kind") == 0, F.concat(F.lit('{"result": {"number": "0x'), F.col("block").cast("string"))).otherwise(
        F.to_json(doc)).alias("value"))
