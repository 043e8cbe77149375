"""Operator 6, near duplicates by SetSketch registers.

A document is the set of its distinct word shingles. Its sketch has one register per hash
function: the smallest exponential variate over the set, truncated to a power of ``BASE``
(``floor(1 - log_b(min))``). Registers merge by maximum and agree more often the more two
sets share. The work runs in these steps:

1. one pass over the texts gives set size, 128-bit set hash and registers; documents with
   equal sets form a class, represented by its smallest id (copies are never expanded);
2. bands of registers put classes into buckets. In each bucket every class is paired with
   one centre, the class that shares most buckets with others;
3. pairs whose sizes alone rule the threshold out are dropped exactly, then those whose
   registers do: the joint likelihood of (above, below, equal) register counts given both
   sizes, maximal over all similarities against maximal over those at or above the
   threshold, must not differ by more than ``MAX_LOG_RATIO``;
4. the rest is confirmed on the full shingle sets;
5. links make components; bucket mates still in different components are compared: those of
   small buckets as pairs, those of larger ones in blocks of bounded size, where the common
   shingles of all pairs of a block are counted at once on the full sets and only links
   that join components leave the task. So a link between different texts is only left out
   if its ends are connected already.

No group is held by a task (blocks of at most ``BLOCK`` classes and ``BLOCK_BYTES`` of
sets), no pairs of a whole bucket are written out, and hub keys go through bounded
broadcasts of numbers, never of sets.

Defined results: null or empty texts and texts without words have an empty set, link with
nothing and are kept; a text with fewer words than a shingle is one shingle; rows that
repeat an id are linked through it; rows without an id get a null component and are kept.
An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm.common import cut, ship
from txgraph.operators.components import connected_components
from txgraph.operators.skew import heavy_keys, split_join

ROWS, BANDS = 6, 21
REGISTERS = ROWS * BANDS
BASE = 1.2
RATE = 20.0
MAX_LOG_RATIO = 7.0
BLOCK = 512
BLOCK_BYTES = 8 << 20
SMALL = 8           # buckets up to this size are compared as plain pairs
PER_COPY = 2000
FILTER_BITS = 22
WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_FUNCS = _rng.integers(1, 2 ** 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hash of words, remembered up to a bound (WORDS of 64 bytes at most, 40 MB or so,
    since workers outlive the operator)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


_words = _WordHashes()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < size:
        h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
        s = (h * _PLACE[:len(w)]).sum(keepdims=True) + np.uint64(len(w))
    else:
        h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
        n = len(h) - size + 1
        s = h[:n] * _PLACE[0]
        for i in range(1, size):
            s = s + h[i:n + i] * _PLACE[i % len(_PLACE)]
    s ^= s >> np.uint64(32)
    s *= _MIX
    s ^= s >> np.uint64(29)
    return np.unique(s)


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: REGISTERS bytes."""
    low = np.full(REGISTERS, ~np.uint64(0), np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (_FUNCS[:, None] * s[None, i:i + 2048]).min(axis=1), out=low)
    u = (low.astype(np.float64) + 1.0) / 2.0 ** 64
    x = -np.log1p(-np.minimum(u, 1.0 - 1e-16)) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def _p(x):
    return -np.log(np.maximum(1.0 - x * (BASE - 1) / BASE, 1e-12)) / np.log(BASE)


def may_link(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray,
             threshold: float) -> np.ndarray:
    """For pairs (rows of registers and set sizes): could the similarity reach the threshold?

    The size bound min/max is exact, the register test a likelihood ratio."""
    na, nb = na.astype(float), nb.astype(float)
    top = np.minimum(na, nb) / np.maximum(na, nb)
    ok = top >= threshold - 1e-12
    idx = np.flatnonzero(ok)
    for part in np.array_split(idx, max(1, len(idx) // 20_000)):
        if not len(part):
            continue
        a, b = ra[part].astype(np.int16), rb[part].astype(np.int16)
        above, below = (a > b).sum(1), (a < b).sum(1)
        ok[part] = _ratio_ok(above, below, na[part], nb[part], top[part], threshold)
    return ok


def _ratio_ok(above, below, na, nb, top, threshold):
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.minimum(_GRID[None, :], top[:, None])
    pa_, pb_ = _p(np.maximum(u - v * j, 1e-9)), _p(np.maximum(v - u * j, 1e-9))
    pe = np.maximum(1.0 - pa_ - pb_, 1e-9)
    ll = (above[:, None] * np.log(pa_) + below[:, None] * np.log(pb_)
          + (REGISTERS - above - below)[:, None] * np.log(pe))
    high = np.where(j >= threshold - 1e-9, ll, -np.inf).max(1)
    return ll.max(1) - high <= MAX_LOG_RATIO


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets, by matrix products over
    ``width`` elements at a time; only elements that both lists have count."""
    x, y = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(x, y)
    out = np.zeros((len(xs), len(ys)))

    def cells(flat, sets):
        row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        col = np.searchsorted(both, flat)
        col[col == len(both)] = 0
        hit = both[col] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    (xr, xc), (yr, yc) = cells(x, xs), cells(y, ys)
    for at in range(0, len(both), width):
        n = min(width, len(both) - at)
        parts = []
        for r, c, k in ((xr, xc, len(xs)), (yr, yc, len(ys))):
            i, j = np.searchsorted(c, [at, at + n])
            m = np.zeros((k, n), np.float32)
            m[r[i:j], c[i:j] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def joining_links(xi, xc, xs, yi, yc, ys, percent: int) -> list[tuple[int, int]]:
    """Links (x, y) between two blocks that join components: at most as many as there are
    components less one. ``i``: nodes, ``c``: their components, ``s``: their sets."""
    common = common_counts(xs, ys)
    union = np.array(list(map(len, xs)))[:, None] + np.array(list(map(len, ys)))[None, :] - common
    hit = (100 * common >= percent * union) & (xc[:, None] != yc[None, :])
    root: dict[int, int] = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for k in np.flatnonzero(hit.any(1)).tolist():
        at = np.flatnonzero(hit[k])
        comps, first = np.unique(yc[at], return_index=True)
        for c, f in zip(comps.tolist(), first.tolist()):
            a, b = find(int(xc[k])), find(c)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(xi[k]), int(yi[at[f]])))
    return out


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, REGISTERS)


def sketch_documents(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc, n, s1, s2, sketch): set size, set hash and registers of every row."""
    ship(df.sparkSession)

    def rows(batches):
        import xxhash

        for b in batches:
            n, s1, s2, sk = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                s1.append((d >> 64) - (1 << 63))
                s2.append((d & ((1 << 64) - 1)) - (1 << 63))
                sk.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()),
                 pa.array(s2, pa.int64()), pa.array(sk, pa.binary())],
                names=["doc", "n", "s1", "s2", "sketch"])

    src = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return src.mapInArrow(rows, "doc bigint, n bigint, s1 bigint, s2 bigint, sketch binary")


def id_filter(ids: DataFrame, col: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit map of fixed size with a bit for every id's hash (it can only let too much by)."""
    slot = F.pmod(F.xxhash64(col), F.lit(1 << bits))
    words = (ids.select(slot.alias("s")).groupBy(F.expr("s div 64").cast("int").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("v")).toArrow())
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def shingle_sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, set): packed shingle hashes of the classes in ``ids`` (node, cls, s1, s2), each
    made anew from the text of its representative."""
    bits = id_filter(ids, "cls")
    bc = df.sparkSession.sparkContext.broadcast(bits)
    n = (1 << FILTER_BITS) - 1

    def rows(batches):
        import xxhash

        known = bc.value
        for b in batches:
            out = ([], [], [], [])
            slot = b.column(2).to_numpy().astype(np.int64) & n
            hit = (known[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            for k in np.flatnonzero(hit).tolist():
                s = shingles(b.column(1)[k].as_py(), size)
                if len(s):
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    for c, v in zip(out, (b.column(0)[k].as_py(), (d >> 64) - (1 << 63),
                                          (d & ((1 << 64) - 1)) - (1 << 63), s.tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(),
                                                      pa.binary()))],
                names=["cls", "s1", "s2", "set"])

    src = (df.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t"))
           .filter(F.col("d").isNotNull()).select("d", "t", F.xxhash64("d").alias("h")))
    sets = src.mapInArrow(rows, "cls bigint, s1 bigint, s2 bigint, set binary")
    return (sets.join(ids.select("node", "cls", "s1", "s2"), ["cls", "s1", "s2"])
            .dropDuplicates(["node"]).select("node", "set"))


def _salted(pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """``pairs`` with the set of one end. An end with very many pairs is dealt over copies
    of its set, ``PER_COPY`` pairs each, so that no set is broadcast and no task holds a hub."""
    per = cut(pairs.groupBy(end).agg(F.count("*").alias("n")), "pair-counts")
    hot = heavy_keys(per, end, "n")
    copies = F.ceil(F.col("n") / PER_COPY).cast("int")
    dealt = (split_join(pairs, per.select(end, copies.alias("copies")), end, hot)
             .withColumn("copy", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")))
    spread = (sets.join(per.withColumnRenamed(end, "node"), "node")
              .select(F.col("node").alias(end), F.col("set").alias("set_" + end),
                      F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy")))
    return dealt.drop("copies").join(spread, [end, "copy"]).drop("copy")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""
    both = _salted(_salted(pairs, sets, "a", "b"), sets, "b", "a")

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p = np.frombuffer(x.as_buffer(), np.uint64)
                q = np.frombuffer(y.as_buffer(), np.uint64)
                both_ = np.concatenate((p, q))
                both_.sort()
                common = int((both_[1:] == both_[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a bigint, b bigint")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ka, kb) that sizes and registers do not rule out, as (a, b)."""

    def check(batches):
        for b in batches:
            if b.num_rows:
                ok = may_link(_matrix(b.column("ka").to_pylist()), _matrix(b.column("kb").to_pylist()),
                              b.column("na").to_numpy(), b.column("nb").to_numpy(), percent / 100)
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(check, "a bigint, b bigint")


def _star_pairs(buckets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of buckets that hold several classes, their hot buckets, and (a, b): every
    class of a bucket with the bucket's centre."""
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("size"))
    shared = cut(sizes.filter(F.col("size") > 1), "bucket-sizes")
    key = F.xxhash64("band", "key")
    hot = heavy_keys(shared.withColumn("bk", key), "bk", "size")
    members = cut(split_join(buckets.withColumn("bk", key),
                             shared.select(key.alias("bk"), "size"), "bk", hot)
                  .select("bk", "node", "size"), "bucket-members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    scored = members.join(weight, "node")
    centre = scored.groupBy("bk").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"))
    pairs = split_join(members, cut(centre, "bucket-centres"), "bk", hot)
    return members, hot, (pairs.filter(F.col("node") != F.col("centre"))
                          .select(F.least("node", "centre").alias("a"),
                                  F.greatest("node", "centre").alias("b")).distinct())


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    hot = {c: heavy_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), c, "n") for c in ("a", "b")}
    for c in ("a", "b"):
        pairs = split_join(pairs, classes.select(
            F.col("node").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("k" + c)), c, hot[c])
    return pairs


def _cross_links(members: DataFrame, hot: DataFrame, classes: DataFrame, sets: DataFrame,
                 links: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between bucket mates that ``links`` leave in different components.

    Only buckets with several components take part. In each, the classes outside the
    bucket's largest component meet all classes of the bucket, block by block, so every
    pair across components is compared. Buckets of at most ``SMALL`` classes give their
    pairs as rows."""
    comp = cut(_components(links), "link-components")
    lab = cut(members.join(comp, "node", "left")
              .select("bk", "node", "size", F.coalesce("component", "node").alias("comp"))
              .join(classes.select("node", "n"), "node"), "bucket-labels")
    per = lab.groupBy("bk", "comp").agg(F.count("*").alias("c"), F.max("size").alias("all"),
                                        F.sum("n").alias("n"))
    main = (per.groupBy("bk").agg(F.count("*").alias("comps"), F.max("all").alias("all"),
                                  F.sum("n").alias("n_all"),
                                  F.max(F.struct("c", "comp", "n")).alias("m"))
            .filter(F.col("comps") > 1)
            .select("bk", F.col("m.comp").alias("main"), "all",
                    F.greatest(F.ceil(F.col("all") / BLOCK),
                               F.ceil(F.col("n_all") * 8 / BLOCK_BYTES)).cast("int").alias("n_in"),
                    F.greatest(F.ceil((F.col("all") - F.col("m.c")) / BLOCK),
                               F.ceil((F.col("n_all") - F.col("m.n")) * 8 / BLOCK_BYTES))
                    .cast("int").alias("n_out")))
    rows = cut(split_join(lab.select("bk", "node", "comp"), cut(main, "bucket-main"), "bk", hot)
               .withColumn("outside", F.col("comp") != F.col("main")), "bucket-open")

    few = rows.filter(F.col("all") <= SMALL)
    x, y = few.select("bk", F.col("node").alias("a"), F.col("comp").alias("ca")), \
        few.select("bk", F.col("node").alias("b"), F.col("comp").alias("cb"))
    small = (x.join(y, "bk").filter("a < b AND ca <> cb").select("a", "b").distinct()
             .join(tried, ["a", "b"], "left_anti"))
    small = cut(_likely(_with_sketches(cut(small, "small-pairs"), classes), percent), "small-likely")

    large = rows.filter(F.col("all") > SMALL)
    h = F.xxhash64("node")
    # each class once per block of outsiders; each outsider once per block of classes
    every = large.select("bk", "node", "comp", F.lit(False).alias("out_side"),
                         F.pmod(h, F.col("n_in")).cast("int").alias("i"),
                         F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("j"))
    outs = large.filter("outside").select(
        "bk", "node", "comp", F.lit(True).alias("out_side"),
        F.explode(F.sequence(F.lit(0), F.col("n_in") - 1)).alias("i"),
        F.pmod(h, F.col("n_out")).cast("int").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.out_side], pdf[~pdf.out_side]
        found = []
        if len(x) and len(y):
            own = (lambda z: [np.frombuffer(b, np.uint64) for b in z["set"]])
            found = joining_links(x.node.to_numpy(), x.comp.to_numpy(), own(x),
                                  y.node.to_numpy(), y.comp.to_numpy(), own(y), percent)
        return pd.DataFrame({"a": [min(f) for f in found], "b": [max(f) for f in found]}, dtype="int64")

    in_blocks = (every.unionByName(outs).join(sets, "node").groupBy("bk", "i", "j")
                 .applyInPandas(compare, "a bigint, b bigint"))
    return _verify(small, sets, percent).unionByName(in_blocks).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = 85, size: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; a link needs ``100 * common >=
    percent * union`` of the shingle sets."""
    docs = cut(sketch_documents(df, id_col, text_col, size), "sketches")
    real = docs.filter(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = cut(real.groupBy("s1", "s2").agg(
        F.min(F.struct("doc", "n", "sketch")).alias("m"), F.count("*").alias("copies"))
        .select("s1", "s2", F.col("m.doc").alias("cls"), F.col("m.n").alias("n"),
                F.col("m.sketch").alias("sketch"), "copies",
                F.monotonically_increasing_id().alias("node")), "classes")
    bands = F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.struct(i.alias("band"), F.xxhash64(
            F.substring(F.col("sketch"), i * ROWS + 1, F.lit(ROWS))).alias("key"))))
    buckets = classes.select("node", bands.alias("x")).select("node", "x.band", "x.key")
    members, hot, stars = _star_pairs(buckets)
    ids = classes.join(members.select("node").distinct(), "node", "left_semi")
    sets = cut(shingle_sets(df, cut(ids.select("node", "cls", "s1", "s2"), "set-ids"),
                            id_col, text_col, size), "shingle-sets")

    tried = cut(_likely(_with_sketches(cut(stars, "star-pairs"), classes), percent), "tried")
    links = cut(_verify(tried, sets, percent), "links")
    more = _cross_links(members, hot, classes, sets, links, tried, percent)
    links = cut(links.unionByName(more), "all-links")
    return _label(docs, classes, links, id_col)


def _label(docs: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """One row per row of ``docs``: classes that share a document id are linked too."""
    key = F.struct("s1", "s2")
    hot = heavy_keys(classes.select(key.alias("k"), "copies"), "k", "copies")
    rows = docs.drop("sketch").withColumn("k", F.when(F.col("doc").isNotNull() & (F.col("n") > 0), key))
    rows = cut(split_join(rows, classes.select(key.alias("k"), "node"), "k", hot, how="left")
               .select("doc", "n", "node"), "document-classes")
    several = (rows.filter(F.col("node").isNotNull()).select("doc", "node").distinct()
               .groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z"),
                                   F.collect_set("node").alias("nodes"))
               .filter(F.col("a") < F.col("z"))
               .select("a", F.explode("nodes").alias("b")).filter(F.col("a") < F.col("b")))
    comp = _components(links.unionByName(several))
    own = classes.join(comp, "node", "left").select(
        "node", "cls", "copies", F.coalesce("component", "node").alias("component"))
    own = cut(own, "class-components")
    least = own.groupBy("component").agg(F.min("cls").alias("least"), F.count("*").alias("n"))
    hot_c = heavy_keys(least, "component", "n")
    named = cut(split_join(own, least.select("component", "least"), "component", hot_c)
                .select("node", "least", "copies"), "class-names")
    hot_n = heavy_keys(named, "node", "copies")
    out = split_join(rows, named.select("node", "least"), "node", hot_n, how="left")
    component = F.coalesce("least", "doc")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                      component.alias("component_id"),
                      F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of the linked nodes."""
    return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
                                ).withColumnRenamed("id", "node")
