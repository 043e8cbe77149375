"""Hot-key handling for joins of a large table with a one-row-per-key table.

A hub address can hold a third of all edges. In ``big ⋈ per_key`` on the address, a
plain shuffle join sends all of the hub's rows to one task. Here the hub keys are
found first, from a weight per key: the keys holding more than ``1/max_keys`` of the
total weight. By pigeonhole there are at most ``max_keys`` of them, a proven bound,
so they (and their one row each of ``per_key``) may be broadcast. Rows of the hubs
then join map-side, without any shuffle; only the remaining rows shuffle, and none
of their keys is hot. AQE's skew-join split stays on as a second line of defence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.session import cut

# Fixed bound on the number of hot keys that may be broadcast.
MAX_HOT_KEYS = 10_000


def heavy_keys(per_key: DataFrame, key: str, weight: str,
               max_keys: int = MAX_HOT_KEYS) -> DataFrame:
    """Keys whose ``weight`` exceeds ``total / max_keys``: at most ``max_keys`` rows.

    One scalar (the total weight) reaches the driver; the result is checkpointed.
    """
    total = per_key.agg(F.sum(weight).alias("w")).first()["w"] or 0
    threshold = total / max_keys
    return cut(per_key.filter(F.col(weight) > F.lit(threshold)).select(key))


def keys_above(per_key: DataFrame, key: str, weight: str, total: int,
               max_keys: int = MAX_HOT_KEYS) -> DataFrame:
    """As :func:`heavy_keys` for a materialised ``per_key`` whose total weight is known.

    At most ``max_keys`` rows as long as ``total`` is the sum of the weights.
    """
    return per_key.filter(F.col(weight) > F.lit(total / max_keys)).select(key)


def split_join(big: DataFrame, per_key: DataFrame, key: str, hot: DataFrame,
               how: str = "inner") -> DataFrame:
    """``big ⋈ per_key`` on ``key``: hot keys through a broadcast, the rest shuffled.

    ``per_key`` must hold at most one row per key, and ``hot`` a bounded key set
    (see :func:`heavy_keys`). ``how`` is ``'inner'`` or ``'left'`` (from ``big``).
    """
    hot_b = F.broadcast(hot.select(key))
    big_hot = big.join(hot_b, key, "left_semi")
    big_cold = big.join(hot_b, key, "left_anti")
    per_hot = F.broadcast(per_key.join(hot_b, key, "left_semi"))
    return big_cold.join(per_key, key, how).unionByName(big_hot.join(per_hot, key, how))
