"""Written tables between the steps of an operator, in parts that follow their size: Spark's
adaptive coalescing reads a small shuffle in few partitions, each with one sort and one hash table.
(``coalesce`` would run those of all its partitions in one task, one after the other.)

A step's result that is read again is written once as Parquet into the shared folder: a lost
executor costs its tasks only, and Spark knows the size. Joins between such tables are planned
on their own: a small side is broadcast by Spark's size check, larger ones are shuffled plainly
on both sides, where the adaptive skew split deals a hub's rows over several tasks. That needs
no pass to find hubs beforehand (compare ``operators.skew``, for sides that are aggregates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from txgraph.session import cut_table


def write(df: DataFrame, count=None) -> tuple[DataFrame, int]:
    """The written table and its number of rows (or of those where ``count`` holds), counted on
    the way: 0 only when there is none."""
    seen = Observation()
    n = F.count(F.lit(1)) if count is None else F.count_if(count)
    out = cut_table(df.observe(seen, n.alias("rows")))
    return out, seen.get["rows"]
