"""Operator 8, near duplicates of vectors by NN-descent.

Vectors of one label are compared by cosine in double precision:

1. equal vectors form a class with a count, so copies are never expanded;
2. a first neighbour graph comes from blocks of classes that fall on the same side of
   random hyperplanes (as many as the label's size asks for). All classes of a block are
   compared, in parts of at most ``BLOCK``, and there are as many independent tables as it
   takes that a pair at the threshold shares no block with a chance of at most ``MISS``,
   whatever else the label holds. Each class keeps its ``LIST`` best neighbours of a
   comparison; links that this leaves out still connect their ends through others;
3. NN-descent: each class is compared with the neighbours of its neighbours, the best
   ``LIST`` neighbours are kept, and so on until a round finds nothing better. Lists hold
   neighbours at ``floor`` or above: two threshold neighbours of one vector are themselves
   at ``2 t^2 - 1`` or above, so lower ones lead nowhere;
4. recall is audited: classes are compared with all classes of their label, ``AUDIT`` first
   and up to ``AUDIT_MOST`` until ``EVIDENCE`` true links were seen, and vectors planted at
   the threshold beside audited classes must share a block with them, so a label without
   links is audited too. Below ``recall`` more tables are added and the descent goes on; if
   ``ATTEMPTS`` do not suffice, each label is compared whole, in blocks, which return counts and
   the edges of a spanning forest;
5. links are the edges at the threshold. A list whose neighbours all reach it is saturated:
   it is enlarged to its whole component, whose classes are compared block by block. Only
   counts leave those tasks, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and those without a label, link with nothing and are kept. Vectors of different length are
not compared. Every row gives a row; rows that repeat an id count as vectors of their own.
A null id takes part but names a component only if no member has an id. An empty table
gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txgraph.llm.common import cut, ship
from txgraph.operators.components import connected_components
from txgraph.operators.skew import heavy_keys, split_join

BLOCK = 512
MISS = 1e-3
LIST = 12
AUDIT = 64
AUDIT_MOST = 1024
EVIDENCE = 64
PLANTS = 4
ATTEMPTS = 4
BITS = 30


def _units(col) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit vectors as an object array) of an Arrow list column."""
    usable = np.zeros(len(col), bool)
    out = np.empty(len(col), object)
    for i, v in enumerate(col):
        if not v.is_valid:
            continue
        x = v.values
        if len(x) == 0 or x.null_count:
            continue
        x = np.asarray(x.to_numpy(zero_copy_only=False), np.float64) + 0.0
        if not np.isfinite(x).all():
            continue
        top = np.abs(x).max()
        if top == 0:
            continue
        y = x / top
        usable[i], out[i] = True, (x, y / np.sqrt((y * y).sum()))
    return usable, out


def _planes(dim: int, table: int) -> np.ndarray:
    return np.random.default_rng((dim, table)).standard_normal((dim, BITS))


def prepare(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, h1, h2, unit): the unit vector as doubles, null where unusable."""
    ship(df.sparkSession)

    def rows(batches):
        import xxhash

        for b in batches:
            ok, vec = _units(b.column(2))
            lab = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            dim, h1, h2, unit = [], [], [], []
            for good, v in zip(ok & lab, vec):
                d = xxhash.xxh3_128_intdigest(v[0].tobytes()) if good else 0
                dim.append(len(v[0]) if good else None)
                h1.append((d >> 64) - (1 << 63) if good else None)
                h2.append((d & ((1 << 64) - 1)) - (1 << 63) if good else None)
                unit.append(v[1].tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dim, pa.int32()), pa.array(h1, pa.int64()),
                 pa.array(h2, pa.int64()), pa.array(unit, pa.binary())],
                names=["id", "label", "dim", "h1", "h2", "unit"])

    src = df.select(F.col(id_col).cast("bigint"), F.col(label_col).cast("string"), F.col(vec_col))
    return src.mapInArrow(
        rows, "id bigint, label string, dim int, h1 bigint, h2 bigint, unit binary")


def _stack(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(-1, dim)


def _depths(threshold: float) -> list[tuple[int, int]]:
    """(bits, tables) by the bits that a label's size asks for: tables enough that a pair at
    the threshold is missed by all with a chance of at most MISS. Where that takes more
    tables than there are blocks, the label is one block."""
    same = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    out = []
    for bits in range(BITS + 1):
        meet = same ** bits
        tables = 1 if meet >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-meet))) if meet > 1e-9 else 1 << 31
        out.append((bits, tables) if tables <= 1 << bits else (0, 1))
    return out


def _with_depth(groups: DataFrame, threshold: float) -> DataFrame:
    """Adds ``bits`` and ``tables`` to (g, size)."""
    depths = _depths(threshold)
    wide = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / (BLOCK / 2)))).cast("int")
    at = F.least(wide, F.lit(BITS)) + 1
    pick = lambda k: F.element_at(F.array(*[F.lit(d[k]) for d in depths]), at)
    return groups.withColumn("bits", pick(0)).withColumn("tables", pick(1))


def _side(x: np.ndarray, table: int, bits: int) -> np.ndarray:
    """Block of each row of ``x`` in a table: on which side of its hyperplanes it falls."""
    return ((x @ _planes(x.shape[1], table)[:, :bits]) >= 0) @ (1 << np.arange(bits, dtype=np.int64))


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that connect what the symmetric matrix ``hit`` connects."""
    todo, a, b = np.ones(len(hit), bool), [], []
    for root in range(len(hit)):
        stack, todo[root] = [root] if todo[root] else [], False
        while stack:
            i = stack.pop()
            new = np.flatnonzero(hit[i] & todo)
            todo[new] = False
            a.append(np.full(len(new), i))
            b.append(new)
            stack += new.tolist()
    return np.concatenate(a), np.concatenate(b)


def _first_edges(classes: DataFrame, groups: DataFrame, hot_g: DataFrame, attempt: int,
                 floor: float, threshold: float) -> DataFrame:
    """(u, v, sim): the best neighbours within blocks of each of an attempt's tables."""

    def sides(batches):
        for b in batches:
            kind = np.stack([b.column(c).to_numpy() for c in ("dim", "bits", "tables")], 1)
            unit = b.column("unit").to_pylist()
            for d, bits, tables in np.unique(kind, axis=0).tolist():
                at = np.flatnonzero((kind == (d, bits, tables)).all(1))
                x, n = _stack([unit[i] for i in at], d), len(at)
                own = b.select(["node", "g"]).take(pa.array(at))
                for t in range(attempt * tables, (attempt + 1) * tables):
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(np.full(n, t, np.int32)), pa.array(_side(x, t, bits))],
                        names=["node", "g", "t", "side"])

    sided = (split_join(classes.select("node", "g", "dim", "unit"),
                        groups.select("g", "bits", "tables"), "g", hot_g)
             .select("node", "g", "dim", "unit", "bits", "tables")
             .mapInArrow(sides, "node bigint, g bigint, t int, side bigint"))
    block = cut(sided.select("node", F.xxhash64("g", "t", "side").alias("blk")), "blocks")
    full = cut(block.groupBy("blk").agg(F.count("*").alias("c")).filter("c > 1"), "block-sizes")
    rows = (split_join(block, full, "blk", heavy_keys(full, "blk", "c"))
            .withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("node", "blk"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("blk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    "own", "node")
            .join(classes.select("node", "dim", "unit"), "node"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, p in pdf.groupby("dim", sort=False):
            x, node, own = _stack(p.unit, int(d)), p.node.to_numpy(), p.own.to_numpy()
            s = x @ x.T
            np.fill_diagonal(s, -2)
            if p.i.iloc[0] != p.j.iloc[0]:
                s[own[:, None] == own[None, :]] = -2     # compared in a part of their own
            link = s >= threshold
            if (link.sum(1) > LIST).any():
                i, j = _forest(link)
                out.append(pd.DataFrame({"u": node[i], "v": node[j], "sim": s[i, j]}))
            for i in range(len(s)):
                at = np.flatnonzero(s[i] >= floor)
                if len(at) > LIST:
                    at = at[np.argpartition(-s[i, at], LIST)[:LIST]]
                if len(at):
                    out.append(pd.DataFrame({"u": node[i], "v": node[at], "sim": s[i, at]}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "sim": []}).astype(
            {"u": "int64", "v": "int64", "sim": "float64"})

    return rows.select("blk", "i", "j", "own", "node", "dim", "unit").groupBy("blk", "i", "j").applyInPandas(
        best, "u bigint, v bigint, sim double")


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")) \
        .groupBy("u", "v").agg(F.max("sim").alias("sim"))


def _lists(edges: DataFrame) -> DataFrame:
    """The LIST best neighbours of each class."""
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return edges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LIST).drop("r")


def _cosines(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """(u, v, sim) of pairs of classes that reach ``floor``."""
    vec = classes.select("node", "unit")
    both = (pairs.join(vec.select(F.col("node").alias("u"), F.col("unit").alias("x")), "u")
            .join(vec.select(F.col("node").alias("v"), F.col("unit").alias("y")), "v"))

    def rows(batches):
        for b in batches:
            s = [float(np.frombuffer(x.as_buffer()) @ np.frombuffer(y.as_buffer()))
                 if len(x.as_buffer()) == len(y.as_buffer()) else -2.0
                 for x, y in zip(b.column("x"), b.column("y"))]
            out = pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(s, pa.float64())],
                                             names=["u", "v", "sim"])
            yield out.filter(pa.array([z >= floor for z in s], pa.bool_()))

    return both.select("u", "v", "x", "y").mapInArrow(rows, "u bigint, v bigint, sim double")


def _descend(edges: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """All edges found by comparing neighbours of neighbours until no list improves."""
    tried = None
    while True:
        lists = cut(_lists(edges), "neighbour-lists")
        hop = (lists.select("u", F.col("v").alias("m"))
               .join(lists.select(F.col("u").alias("m"), F.col("v").alias("w")), "m")
               .filter("u < w").select("u", F.col("w").alias("v")).distinct()
               .join(edges.select("u", "v"), ["u", "v"], "left_anti"))
        if tried is not None:
            hop = hop.join(tried, ["u", "v"], "left_anti")
        hop = cut(hop, "hop-pairs")
        found = cut(_both(_cosines(hop, classes, floor)), "hop-edges")
        grown = cut(edges.unionByName(found), "edges")
        better = _lists(grown).join(found.select("u", "v"), ["u", "v"], "left_semi")
        done = better.isEmpty()
        edges = grown
        if done:
            return edges
        tried = hop if tried is None else tried.unionByName(hop)


def _planted(classes: DataFrame, groups: DataFrame, attempts: int, threshold: float) -> float:
    """Share of vectors planted at the threshold beside AUDIT classes that share a block with
    theirs in one of the tables so far."""
    sample = classes.orderBy(F.xxhash64("node", F.lit(2))).limit(AUDIT).select("g", "unit")
    rng, met = np.random.default_rng(3), []
    for r in sample.join(groups, "g").select("unit", "bits", "tables").collect():     # AUDIT rows
        x = np.frombuffer(bytes(r.unit))
        z = rng.standard_normal((PLANTS, len(x)))
        z -= (z @ x)[:, None] * x
        size = np.sqrt((z * z).sum(1))[:, None]
        t = min(1.0, max(-1.0, threshold))
        y = np.where(size > 1e-9, t * x + np.sqrt(1 - t * t) * z / np.maximum(size, 1e-9), x)
        hit = np.zeros(PLANTS, bool)
        for table in range(attempts * r.tables):
            side = _side(np.concatenate((x[None, :], y)), table, r.bits)
            hit |= side[1:] == side[0]
        met.append(hit.mean())
    return float(np.mean(met)) if met else 1.0


def _true_links(classes: DataFrame, count: int, threshold: float) -> DataFrame:
    """(u, v): all links of ``count`` classes u, drawn by hash."""
    sample = classes.orderBy(F.xxhash64("node", F.lit(1))).limit(count).select("node", "g", "unit")
    probes: dict = {}
    for r in sample.collect():                                        # AUDIT_MOST rows at most
        probes.setdefault(r.g, []).append((r.node, bytes(r.unit)))

    def rows(batches):
        for b in batches:
            units = b.column("unit").to_pylist()
            g, node = b.column("g").to_numpy(), b.column("node").to_numpy()
            for pg in np.intersect1d(g, list(probes)).tolist():
                at = np.flatnonzero(g == pg)
                who = np.array([n for n, _ in probes[pg]])
                x = _stack([u for _, u in probes[pg]], len(probes[pg][0][1]) // 8)
                hit = _stack([units[i] for i in at], x.shape[1]) @ x.T >= threshold
                i, j = np.nonzero(hit & (node[at][:, None] != who[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(who[j]), pa.array(node[at][i])],
                                                 names=["u", "v"])

    return cut(classes.select("node", "g", "unit").mapInArrow(rows, "u bigint, v bigint"), "audit")


def _recall(classes: DataFrame, groups: DataFrame, edges: DataFrame, attempts: int,
            threshold: float) -> float:
    """Share of true links that are listed or lie within a component of saturated lists
    (which is compared whole later), but no more than of planted ones that share a block."""
    links = edges.filter(F.col("sim") >= threshold).select("u", "v")
    comp = cut(_components(edges, threshold), "audit-components")
    whole = cut(comp.join(_saturated(links, comp), "component", "left_semi"), "audit-saturated")
    count, total = AUDIT, classes.count()
    while True:
        true = _true_links(classes, count, threshold)
        own = (true.join(links.withColumn("listed", F.lit(True)), ["u", "v"], "left")
               .join(whole.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
               .join(whole.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
               .agg(F.count("*").alias("n"),
                    F.count(F.when(F.col("listed") | (F.col("cu") == F.col("cv")), 1)).alias("hit"))
               .first())
        if own.n >= EVIDENCE or count >= min(total, AUDIT_MOST):
            break
        count *= 4
    planted = _planted(classes, groups, attempts, threshold)
    return min(planted, own.hit / own.n) if own.n else planted


def _saturated(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Components with a class whose whole list reaches the threshold."""
    return (links.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= LIST)
            .select(F.col("u").alias("node")).join(comp, "node")
            .select("component").distinct())


def _components(edges: DataFrame, threshold: float) -> DataFrame:
    links = edges.filter(F.col("sim") >= threshold).filter("u < v")
    return connected_components(links.select(F.col("u").alias("src"), F.col("v").alias("dst"))
                                ).withColumnRenamed("id", "node")


def _compare_blocks(members: DataFrame, sizes: DataFrame, classes: DataFrame,
                    threshold: float, forest: bool) -> DataFrame:
    """All classes of a group (``members``: node, comp) compared, block by block: rows (node,
    links) say how many vectors of a block each links with; with ``forest`` rows (node, other)
    besides connect what a block's links connect, fewer than it has classes."""
    hot = heavy_keys(sizes, "comp", "n")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = (split_join(members, sizes, "comp", hot).withColumn("parts", parts)
            .join(classes.select("node", "copies", "dim", "unit"), "node")
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cols = ["comp", "node", "copies", "dim", "unit"]
    left = rows.select(*cols, F.lit(True).alias("asks"), F.col("own").alias("i"), every.alias("j"))
    right = rows.select(*cols, F.lit(False).alias("asks"), every.alias("i"), F.col("own").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, p in pdf.groupby("dim", sort=False):
            x, y = p[p.asks], p[~p.asks]
            if not len(x) or not len(y):
                continue
            xn, yn = x.node.to_numpy(), y.node.to_numpy()
            sim = _stack(x.unit, int(d)) @ _stack(y.unit, int(d)).T
            hit = (sim >= threshold) & (xn[:, None] != yn[None, :])
            out.append(pd.DataFrame({"node": xn, "links": hit @ y.copies.to_numpy().astype(np.int64)}))
            if forest and p.i.iloc[0] <= p.j.iloc[0]:       # the block of j and i has the same links
                every, at = np.unique(np.concatenate((xn, yn)), return_inverse=True)
                near = np.zeros((len(every), len(every)), bool)
                near[np.ix_(at[:len(xn)], at[len(xn):])] = hit
                i, j = _forest(near | near.T)
                out.append(pd.DataFrame({"node": every[i], "other": every[j]}))
        if not out:
            return pd.DataFrame({"node": [], "links": [], "other": []}).astype("Int64")
        return pd.concat(out).reindex(columns=["node", "links", "other"]).astype("Int64")

    return (left.unionByName(right).groupBy("comp", "i", "j").applyInPandas(
        compare, "node bigint, links bigint, other bigint"))


def vector_near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                           label_col: str = "label", threshold: float = 0.98,
                           floor: float | None = None, recall: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    floor = 2 * threshold ** 2 - 1 if floor is None else floor
    rows = cut(prepare(df, id_col, vec_col, label_col), "unit-vectors")
    key = F.xxhash64("label", "dim", "h1", "h2")
    classes = cut(rows.filter(F.col("unit").isNotNull())
                  .groupBy("label", "dim", "h1", "h2")
                  .agg(F.min("id").alias("least"), F.count("*").alias("copies"),
                       F.min("unit").alias("unit"))
                  .withColumn("node", F.monotonically_increasing_id())
                  .withColumn("g", F.xxhash64("label", "dim")), "vector-classes")
    groups = cut(_with_depth(classes.groupBy("g").agg(F.count("*").alias("size")), threshold),
                 "label-sizes")
    hot_g = heavy_keys(groups, "g", "size")

    edges, found = None, 0.0
    for attempt in range(ATTEMPTS):
        more = _both(_first_edges(classes, groups, hot_g, attempt, floor, threshold))
        edges = cut(more if edges is None else _both(edges.unionByName(more)), "first-edges")
        edges = _descend(edges, classes, floor)
        found = _recall(classes, groups, edges, attempt + 1, threshold)
        if found >= recall:
            break

    if found < recall:      # compare each label whole
        counted = cut(_compare_blocks(
            classes.select("node", F.col("g").alias("comp")),
            groups.select(F.col("g").alias("comp"), F.col("size").alias("n")),
            classes, threshold, forest=True), "label-links")
        comp = cut(connected_components(
            counted.filter("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst")))
            .withColumnRenamed("id", "node"), "vector-components")
        n = classes.join(comp, "node", "left").withColumn("listed", F.lit(None).cast("bigint"))
    else:
        links = cut(edges.filter(F.col("sim") >= threshold).select("u", "v"), "links")
        comp = cut(_components(edges, threshold), "vector-components")
        full = _saturated(links, comp).withColumnRenamed("component", "comp")
        sizes = cut(comp.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("n"))
                    .join(full, "comp"), "saturated")
        counted = _compare_blocks(comp.select("node", F.col("component").alias("comp")), sizes, classes,
                                  threshold, forest=False)
        # outside of these every class lists all its links, fewer than LIST
        inside = comp.join(sizes, F.col("component") == F.col("comp"), "left_semi").select(F.col("node").alias("u"))
        listed = (cut(links.join(inside, "u", "left_anti"), "listed-links")
                  .join(classes.select(F.col("node").alias("v"), "copies"), "v")
                  .groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("listed")))
        n = classes.join(comp, "node", "left").join(listed, "node", "left")
    exact = counted.groupBy("node").agg(F.sum("links").alias("exact"))
    n = (n.join(exact, "node", "left")
         .select("label", "dim", "h1", "h2", "copies", "least", "node",
                 F.coalesce("component", "node").alias("component"),
                 (F.col("copies") - 1 + F.coalesce("exact", "listed", F.lit(0))).alias("n_links")))
    n = cut(n, "class-links")
    name = n.groupBy("component").agg(F.min("least").alias("name"), F.count("*").alias("size"))
    name = cut(name, "component-names")
    named = cut(split_join(n, name.select("component", "name"), "component",
                           heavy_keys(name, "component", "size"))
                .select(key.alias("k"), "copies", "n_links", "name"), "class-names")
    out = split_join(rows.withColumn("k", F.when(F.col("unit").isNotNull(), key)).select("id", "k"),
                     named.select("k", "n_links", "name"), "k",
                     heavy_keys(named, "k", "copies"), how="left")
    component = F.coalesce("name", "id")
    return out.select(F.col("id").alias(id_col),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
