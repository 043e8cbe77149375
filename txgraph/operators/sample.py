"""Samples of a transaction table (B11, B13) and keyed dedup.

The collector's crawls are re-aimed as queries over a stored transaction table
``tx(hash, src, dst, value, height)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from txgraph.operators.written import write

TX_COLS = ("hash", "src", "dst", "value", "height")


def win_order(height: str = "height", pos: str | None = "pos") -> list:
    """E2's order, the winner first: lowest height, then highest position, missing ones last."""
    order = [F.col(height).isNull().alias("_hn"), F.col(height).alias("_h")]
    if pos is not None:
        order += [F.col(pos).isNull().alias("_pn"), (-F.col(pos)).alias("_p")]
    return order


def dedup_last_wins(rows: DataFrame, key: str = "hash", height: str = "height",
                    pos: str = "pos") -> DataFrame:
    """One row per ``key``; the winner has the lowest height, then the highest position
    (a missing height or position loses to any other).

    (The block collector visits heights downwards and overwrites by key, so the
    last write is the lowest block, last position.) A ``groupBy`` with ``min(struct)``
    combines map-side: a key repeated in a third of all rows costs one partial row
    per task, never one task holding every copy.
    """
    order = win_order(height, pos if pos in rows.columns else None)
    rest = [c for c in rows.columns if c != key]
    # height and position are in the order already: a shuffled row carries them once
    led = {height: F.col("w._h")}
    if pos in rows.columns and isinstance(rows.schema[pos].dataType, T.IntegralType):
        led[pos] = -F.col("w._p")
    best = rows.groupBy(key).agg(
        F.min(F.struct(*order, *[F.col(c).alias(f"v{i}") for i, c in enumerate(rest) if c not in led])).alias("w"))
    return best.select(key, *[
        led.get(c, F.col(f"w.v{i}")).cast(rows.schema[c].dataType).alias(c) for i, c in enumerate(rest)])


def node_table(edges: DataFrame) -> DataFrame:
    """``(address)`` = distinct senders union distinct receivers, missing ends left out."""
    return (
        edges.select(F.col("src").alias("address"))
        .unionByName(edges.select(F.col("dst").alias("address")))
        .filter(F.col("address").isNotNull())
        .distinct()
    )


def block_range_sample(tx: DataFrame, block_number: int, max_blocks: int) -> DataFrame:
    """The ``max_blocks`` blocks ending at ``block_number`` (heights
    ``block_number - max_blocks + 1 .. block_number``), deduplicated by hash (E2).

    The height predicate is a plain filter, so it reaches the scan / partition
    pruning when ``height`` is a stored or partition column.
    """
    lo = block_number - max_blocks + 1
    rows = tx.filter(F.col("height").between(lo, block_number))
    return dedup_last_wins(rows)


def incidence_top(tx: DataFrame, fanout: int, addresses: DataFrame | None = None) -> DataFrame:
    """Per address its ``fanout`` latest transactions by (height desc, hash asc).

    With ``addresses`` only rows incident to them are ranked. ``row_number() <= k`` is
    planned with a partial window-group limit before the shuffle, so a hot address sends at
    most ``k`` rows per map task. A self-transfer is incident once.
    """
    cols = [F.col(c) for c in TX_COLS]
    sent = tx.select(F.col("src").alias("address"), *cols)
    got = tx.filter(~F.col("dst").eqNullSafe(F.col("src"))).select(F.col("dst").alias("address"), *cols)
    inc = sent.unionByName(got).filter(F.col("address").isNotNull())
    if addresses is not None:
        inc = inc.join(addresses.select("address"), "address", "left_semi")
    return _latest(inc, fanout)


def _latest(inc: DataFrame, fanout: int) -> DataFrame:
    w = Window.partitionBy("address").orderBy(F.desc("height"), F.asc("hash"))
    return inc.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= fanout).drop("rk")


def seed_block(tx: DataFrame, min_height: int) -> int | None:
    """Height of the first block at or above ``min_height`` (a scalar)."""
    row = tx.filter(F.col("height") >= min_height).agg(F.min("height").alias("h")).first()
    return None if row is None else row["h"]


def snowball_sample(tx: DataFrame, seed_height: int, seed_count: int = 5,
                    fanout: int = 5, hops: int = 3, incident=None) -> DataFrame:
    """K-hop snowball sample: ``(hash, src, dst, value, height, hop)``.

    Seeds: the first ``seed_count`` transactions (by hash) of the first block with
    height >= ``seed_height``. Each hop takes the addresses of the transactions reached
    in the previous hop that were not expanded yet, and adds each address's
    ``fanout`` latest transactions not reached yet. ``hop`` is the hop that first
    reached the transaction. The table is written once; a hop first cuts it down to the rows
    incident to its frontier, then ranks those; every hop's state is a written table, whose size
    Spark knows, so a small frontier is broadcast and the table not shuffled; the visited sets stay
    distributed (anti-joins). ``hash`` identifies a transaction: rows must not repeat.

    ``incident``: a function from ``(address)`` rows to the rows ``(address, *TX_COLS)`` incident to
    them, such as a stored index (``sources.store.read_incidence``), read instead of ``tx``.
    """
    base = tx.select(*TX_COLS)
    if incident is None:
        base, _ = write(base)
    h0 = seed_block(base, seed_height)
    if h0 is None:
        return base.limit(0).withColumn("hop", F.lit(0).cast("int"))
    frontier, _ = write(base.filter(F.col("height") == h0).orderBy("hash").limit(seed_count))
    reached = frontier.withColumn("hop", F.lit(0))
    seen = None
    for hop in range(1, hops + 1):
        addrs = frontier.select(F.col("src").alias("address")).unionByName(
            frontier.select(F.col("dst").alias("address"))).distinct()
        if seen is not None:
            addrs = addrs.join(seen, "address", "left_anti")
        addrs, _ = write(addrs)
        seen = addrs if seen is None else seen.unionByName(addrs)
        latest = incidence_top(base, fanout, addrs) if incident is None else _latest(incident(addrs), fanout)
        new = (
            latest.select(*TX_COLS).distinct()
            .join(reached.select("hash"), "hash", "left_anti")
        )
        frontier, _ = write(new)
        reached = reached.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return reached
