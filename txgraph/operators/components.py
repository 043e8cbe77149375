"""Connected components (D1), component sizes and the greatest-k subgraph.

D1 contracts edges until none is left:

1. every vertex points at its smallest neighbour ``m``, in an order that a random XOR of the
   ids gives anew each round. Pointers lead from ``v`` over ``m(v)`` to ``m(m(v))``, which is
   never greater than ``v``, so every tree of pointers has two vertices or more;
2. ``r(v) = min(m(v), m(m(v)))``, followed once more (``r(r(v))``), stands for ``v``;
3. edges are renamed by ``r``; those whose ends fall together and repeated ones go. Vertices
   without an edge left are finished and drop out by themselves.

The edge table shrinks by a constant factor a round (expected, whatever the graph: a chain of
``L`` pointers in one direction has a chance of at most ``1/L`` under a random XOR), so the
rounds together cost about as much as the first. The ``r`` tables shrink alike and are joined
from the last to the first; the smallest id of each group then names its component.

All state is written tables in the shared folder, so a lost executor costs its tasks only, and
their known sizes let small ones be broadcast by Spark. Every join is between two plainly
shuffled tables, so Spark's adaptive skew split deals a hub's rows over several tasks when,
and only when, its partition exceeds the configured share. Minima and ``distinct`` combine
map-side. Per round the driver learns one number, the edges left.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.operators.build import induced_edges
from txgraph.operators.written import write

# An edge table of fewer rows is small: what is made of it is not worth a table of its own.
SMALL_ROWS = 200_000


def _salt(rnd: int) -> int:
    return random.Random(rnd).getrandbits(64) - (1 << 63)


def nearest(e: DataFrame, salt: int) -> DataFrame:
    """``(u, m)``: the neighbour of each end with the smallest id XOR ``salt``."""
    mix = F.lit(salt).cast("bigint")
    both = e.select(F.col("a").alias("u"), F.col("b").bitwiseXOR(mix).alias("x")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").bitwiseXOR(mix).alias("x")))
    return both.groupBy("u").agg(F.min("x").bitwiseXOR(mix).alias("m"))


def followed(m: DataFrame, salt: int) -> DataFrame:
    """``(u, r)`` with ``r = min(m(u), m(m(u)))`` in the order of the round."""
    mix = F.lit(salt).cast("bigint")
    nxt = m.select(F.col("u").alias("m"), F.col("m").alias("m2"))
    return m.join(nxt, "m").select("u", F.least(
        F.col("m").bitwiseXOR(mix), F.col("m2").bitwiseXOR(mix)).bitwiseXOR(mix).alias("r"))


def jumped(r: DataFrame) -> DataFrame:
    """``(u, r(r(u)))``; every ``r`` is itself a vertex of the table."""
    nxt = r.select(F.col("u").alias("r"), F.col("r").alias("r2"))
    return r.join(nxt, "r").select("u", F.col("r2").alias("r"))


def contracted(e: DataFrame, r: DataFrame) -> DataFrame:
    """The edges ``(a, b)``, ``a < b``, between what stands for the ends of ``e``."""
    x = e.join(r.select(F.col("u").alias("a"), F.col("r").alias("ra")), "a")
    x = x.join(r.select(F.col("u").alias("b"), F.col("r").alias("rb")), "b")
    return x.filter(F.col("ra") != F.col("rb")).select(
        F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, component)``; direction ignored; label = smallest id; isolates label themselves.

    An edge with a missing end links nothing; its other end is a vertex. The source is read
    once. There is no bound on the rounds: they end when no edge is left.
    """
    # least and greatest pass over NULL: a lone end becomes a loop, which only names a vertex
    pairs, rows = write(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
                         .filter(F.col("a").isNotNull()).distinct())
    lone = pairs.filter(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
    e = pairs.filter(F.col("a") < F.col("b")).select("a", "b")
    maps: list[DataFrame] = []
    while rows:
        salt = _salt(len(maps))
        r = followed(nearest(e, salt), salt)
        if rows > SMALL_ROWS:       # read twice: worth a table of its own unless small
            r, _ = write(r)
        r, ends = write(jumped(r))
        if not ends:
            break
        maps.append(r)
        e, rows = write(contracted(e, r))
    others = lone if vertices is None else lone.unionByName(vertices.select("id")).filter(
        F.col("id").isNotNull()).distinct()
    if not maps:
        return others.select("id", F.col("id").alias("component"))
    stands = maps[-1]
    for r in reversed(maps[:-1]):
        far = stands.select(F.col("u").alias("r"), F.col("r").alias("far"))
        stands = r.join(far, "r", "left").select("u", F.coalesce("far", "r").alias("r"))
    stands, _ = write(stands)
    names, _ = write(stands.groupBy("r").agg(F.min("u").alias("component")))
    labels = stands.join(names, "r").select(F.col("u").alias("id"), "component")
    rest = others.join(stands.select(F.col("u").alias("id")), "id", "left_anti")
    return labels.unionByName(rest.select("id", F.col("id").alias("component")))


def component_sizes(components: DataFrame) -> DataFrame:
    """``(component, size)``."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def greatest_components(components: DataFrame, k: int = 1) -> DataFrame:
    """The k greatest components ``(component, size)``: size desc, then smallest label.

    At most ``k`` rows, a proven bound, so the result may be broadcast.
    """
    return (
        component_sizes(components)
        .orderBy(F.desc("size"), F.asc("component"))
        .limit(k)
    )


def top_components(edges: DataFrame, components: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(id, component)`` and edges of the k greatest components.

    ``k = 0`` gives an empty graph. Selection is a semi-join against at most k labels;
    no vertex set is ever held by the driver.
    """
    if k <= 0:
        return components.limit(0), edges.limit(0)
    top = F.broadcast(greatest_components(components, k).select("component"))
    verts = components.join(top, "component", "left_semi").select("id", "component")
    return verts, induced_edges(edges, verts.select("id"), both_ends=False)
