"""JSON payload sources (A3-A6): block, transaction and address records.

Each extractor is a ``DataFrame -> DataFrame`` function over parsed records, usable
with ``df.transform``. Records come from files (``read_json``, lines read as text, so a
stream parses the same way) or from a column of JSON text (``parse_json``); malformed
lines are kept in ``_corrupt_record``. What an extractor cannot use is not lost:
``rejects`` returns those records and ``corrupt_count`` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txgraph import schema as S
from txgraph.functions.hexval import hex_quantity, strip_0x
from txgraph.functions.scalars import first_of_first
from txgraph.session import cut_table

NULL_TO = ("keep", "drop_row", "drop_block")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines files with an explicit schema; bad lines land in ``_corrupt_record``."""
    return parse_json(spark.read.text(path), schema, "value")


def parse_json(text: DataFrame, schema: T.StructType, col: str = "json") -> DataFrame:
    """Parse a column of JSON text into the record columns (null record when malformed)."""
    parsed = text.select(F.from_json(F.col(col), S.with_corrupt(schema),
                                     {"mode": "PERMISSIVE",
                                      "columnNameOfCorruptRecord": S.CORRUPT}).alias("r"))
    return parsed.select("r.*")


def corrupt_count(records: DataFrame) -> DataFrame:
    """One row ``(corrupt)``: how many input lines did not parse."""
    return records.agg(F.count_if(F.col(S.CORRUPT).isNotNull()).alias("corrupt"))


def rejects(records: DataFrame, required: str = "result") -> DataFrame:
    """The records an extractor passes over: malformed ones and those without the field it
    needs (``result`` for v2 blocks, ``hash`` for v1 blocks and transactions, ``address``)."""
    bad = F.col(S.CORRUPT).isNotNull() if S.CORRUPT in records.columns else F.lit(False)
    return records.filter(bad | F.col(required).isNull())


def split_lines(lines: DataFrame, null_to: str = "keep", col: str = "value",
                seen: Observation | None = None) -> DataFrame:
    """A3 and its rejects from one parse: ``(height, pos, hash, src, dst, value, _corrupt_record)``.

    A row per transaction (see :func:`ingest_blocks`), and one per line that is no block, whose
    text is in ``_corrupt_record`` and whose other columns are NULL. ``seen`` is filled with
    ``transactions`` and ``rejected``, counted while the rows pass. Works on streams, too.
    """
    if null_to not in NULL_TO:
        raise ValueError(f"null_to must be one of {NULL_TO}")
    r = lines.select(F.col(col).alias("line"), F.from_json(
        F.col(col), S.with_corrupt(S.BLOCK_CONTAINER),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}).alias("r"))
    bad = F.coalesce(F.col(f"r.{S.CORRUPT}").isNotNull(), F.lit(False)) | F.col("r.result").isNull()
    txs, none = F.col("r.result.transactions"), F.lit(None).cast(T.ArrayType(S.TRANSACTION2))
    if null_to == "drop_block":
        txs = F.when(~F.exists(txs, lambda t: t["to"].isNull()), txs).otherwise(none)
    one = F.array(F.lit(None).cast(S.TRANSACTION2))
    rows = r.select(
        F.when(bad, F.coalesce("line", F.lit(""))).alias(S.CORRUPT),
        F.when(F.col("r.result.number").isNotNull(), hex_quantity(F.col("r.result.number"))).alias("height"),
        F.posexplode(F.when(bad, one).otherwise(txs)).alias("pos", "t"))
    ok = F.col(S.CORRUPT).isNull()
    if null_to == "drop_row":
        rows = rows.filter(~ok | F.col("t.to").isNotNull())
    out = rows.select(
        F.when(ok, F.col("height")).alias("height"), F.when(ok, F.col("pos").cast("bigint")).alias("pos"),
        strip_0x(F.col("t.hash")).alias("hash"), strip_0x(F.col("t.from")).alias("src"),
        strip_0x(F.col("t.to")).alias("dst"), F.when(ok, hex_quantity(F.col("t.value"))).alias("value"), S.CORRUPT)
    if seen is not None:
        out = out.observe(seen, F.count_if(F.col(S.CORRUPT).isNull()).alias("transactions"),
                          F.count_if(F.col(S.CORRUPT).isNotNull()).alias("rejected"))
    return out


def ingest_lines(lines: DataFrame, null_to: str = "keep",
                 col: str = "value") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """A3 over lines of text, read once: the written transactions, the rejected lines
    ``(_corrupt_record)``, and the counts ``transactions`` and ``rejected`` of the same pass."""
    seen = Observation()
    rows = cut_table(split_lines(lines, null_to, col, seen), "ingest")
    bad = F.col(S.CORRUPT).isNotNull()
    return rows.filter(~bad).drop(S.CORRUPT), rows.filter(bad).select(S.CORRUPT), dict(seen.get)


def ingest_blocks(blocks: DataFrame, null_to: str = "keep") -> DataFrame:
    """A3: v2 block records -> ``(height, pos, hash, src, dst, value)``.

    ``0x`` is stripped from hash, sender and receiver (C1); the value is decoded from
    hex, saturating at 9223372036854775807 (C2). ``height`` comes from the block's
    ``number`` tag when present, else NULL. ``pos`` is the position in the block.
    A transaction without receiver (contract creation): ``null_to='keep'`` keeps it with
    ``dst`` NULL, ``'drop_row'`` drops the transaction, ``'drop_block'`` its whole block (what
    the source does, whose record type demands a receiver).
    """
    if null_to not in NULL_TO:
        raise ValueError(f"null_to must be one of {NULL_TO}")
    ok = blocks.filter(F.col("result").isNotNull())
    if null_to == "drop_block":
        ok = ok.filter(~F.coalesce(
            F.exists("result.transactions", lambda t: t["to"].isNull()), F.lit(False)))
    tx = ok.select(
        F.when(F.col("result.number").isNotNull(), hex_quantity(F.col("result.number")))
        .alias("height"),
        F.posexplode("result.transactions").alias("pos", "t"),
    )
    if null_to == "drop_row":
        tx = tx.filter(F.col("t.to").isNotNull())
    return tx.select(
        "height",
        F.col("pos").cast("bigint").alias("pos"),
        strip_0x(F.col("t.hash")).alias("hash"),
        strip_0x(F.col("t.from")).alias("src"),
        strip_0x(F.col("t.to")).alias("dst"),
        hex_quantity(F.col("t.value")).alias("value"),
    )


def ingest_block_txids(blocks: DataFrame) -> DataFrame:
    """A4: v1 block records -> ``(block_hash, height, pos, txid)``."""
    return blocks.filter(F.col("hash").isNotNull()).select(
        F.col("hash").alias("block_hash"), "height",
        F.posexplode("txids").alias("pos", "txid"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


def ingest_tx_edges(txs: DataFrame) -> DataFrame:
    """A5: v1 transaction records -> one edge ``(hash, src, dst, value)``.

    Sender = first address of the first input, receiver = first address of the
    first output (C4), weight = ``total``. Empty lists give NULL instead of failing.
    """
    return txs.filter(F.col("hash").isNotNull()).select(
        "hash",
        first_of_first("inputs", "addresses").alias("src"),
        first_of_first("outputs", "addresses").alias("dst"),
        F.col("total").alias("value"),
    )


def ingest_address_refs(addresses: DataFrame, limit: int | None = None) -> DataFrame:
    """v1 address records -> their transaction references, all or the first ``limit``
    (the source's service returned pages of 5).

    A missing ``txrefs`` list means none. Output ``(address, pos, tx_hash, tx_input_n,
    tx_output_n, value, double_spend, confirmations, ref_balance, confirmed, double_of)``.
    """
    refs: Column = F.coalesce("txrefs", F.array().cast(T.ArrayType(S.TRANSACTION_REF)))
    if limit is not None:
        refs = F.slice(refs, 1, limit)
    return addresses.filter(F.col("address").isNotNull()).select(
        "address", F.posexplode(refs).alias("pos", "r")
    ).select("address", F.col("pos").cast("bigint").alias("pos"), "r.*")
