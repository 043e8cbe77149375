"""Explicit schemas of every record the engine reads or writes (no inference)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# CSV tables (the collector output / analysis input).
VERTEX_CSV = _struct(("address", S))
EDGE_CSV = _struct(("hash", S), ("in", S), ("out", S), ("value", L))

# v2: block-range payloads. ``number`` (the block tag) is optional; when present
# it gives the height of every transaction of the block.
TRANSACTION2 = _struct(("hash", S), ("from", S), ("to", S), ("value", S))
BLOCK2 = _struct(("number", S), ("transactions", T.ArrayType(TRANSACTION2)))
BLOCK_CONTAINER = _struct(("result", BLOCK2))

# v1: address-crawl payloads.
TRANSACTION_INPUTS = _struct(("sequence", L), ("addresses", T.ArrayType(S)))
TRANSACTION_OUTPUTS = _struct(("value", L), ("addresses", T.ArrayType(S)))
TRANSACTION_REF = _struct(
    ("tx_hash", S), ("tx_input_n", I), ("tx_output_n", I), ("value", L), ("double_spend", B),
    ("confirmations", L), ("ref_balance", L), ("confirmed", S), ("double_of", S))
ADDRESS = _struct(
    ("address", S), ("total_received", L), ("total_sent", L), ("balance", L),
    ("unconfirmed_balance", L), ("final_balance", L), ("n_tx", L), ("unconfirmed_n_tx", L),
    ("final_n_tx", L), ("tx_url", S), ("txrefs", T.ArrayType(TRANSACTION_REF)),
    ("unconfirmed_txrefs", T.ArrayType(TRANSACTION_REF)), ("hasMore", B))
BLOCK = _struct(
    ("n_tx", I), ("txids", T.ArrayType(S)), ("hash", S), ("height", L), ("prev_block", S),
    ("prev_block_url", S), ("chain", S), ("depth", L), ("total", L), ("fees", L), ("size", L),
    ("ver", I), ("time", S), ("received_time", S), ("coinbase_addr", S), ("relayed_by", S),
    ("nonce", L), ("tx_url", S), ("mrkl_root", S))
TRANSACTION = _struct(
    ("block_height", L), ("hash", S), ("addresses", T.ArrayType(S)), ("total", L), ("fees", L),
    ("size", L), ("gas_used", L), ("gas_price", L), ("received", S), ("ver", I),
    ("double_spend", B), ("vin_sz", I), ("vout_sz", I), ("confirmations", L),
    ("inputs", T.ArrayType(TRANSACTION_INPUTS)), ("outputs", T.ArrayType(TRANSACTION_OUTPUTS)))

CORRUPT = "_corrupt_record"


def with_corrupt(schema: T.StructType) -> T.StructType:
    """The schema plus the column that receives malformed JSON lines."""
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, S, True)])
