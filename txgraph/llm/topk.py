"""Operator 4, exact top-k search with an impact-ordered, score-at-a-time index.

Components are quantised to ``floor(scale * x)``; the score is the integer inner product.
Candidates are dealt to shards of about ``SHARD`` vectors (fewer where vectors are long), queries
to blocks of ``QUERIES``, and every block meets every shard in one task, which builds the
shard's index once for the whole block.

A shard's index orders the postings of every dimension by impact: segment b holds the components
with b binary digits. A query component with a digits meets segment b with an impact below
``2 ** (a + b)`` on either side of zero, so queries take segments by descending a + b, a tile of
queries at a time, and add them to accumulators. What a candidate may still gain is at most the
next impact in every dimension; candidates whose accumulator plus that bound is below the k-th
best exact score known are out - proven, not guessed. When few enough are left (``RESCORE`` of a
shard), or no segment remains, the possible members are scored exactly; other queries of the
tile go on. The best k of each shard are merged by a window whose partial limit runs before the
shuffle. Sums are exact: in single or double precision only while all of them are integers that it holds.

Defined results: vectors that are null or hold null or non-finite components take no part;
vectors of different length are not compared; ties go to the smaller id (null ids last);
rows that repeat an id are rows of their own, and only the query's own row is left out. An
empty table gives no rows. Scores that do not fit 64 bits raise an error. Only the id and
the vector column are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txgraph.llm.common import cut, ship
from txgraph.operators.skew import heavy_keys, split_join

SHARD = 8_192
SHARD_ENTRIES = 1 << 20
QUERIES = 4_096
TILE = 1 << 21
RESCORE = 0.04


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, dim, q): components as packed 64-bit integers; unusable vectors are left out."""
    ship(df.sparkSession)

    def rows(batches):
        for b in batches:
            ids, dims, qs = [], [], []
            for i, v in zip(b.column(0), b.column(1)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x)
                if len(q) and np.abs(q).max() > 2.0 ** 31:
                    raise OverflowError("quantised components must fit 32 bits")
                ids.append(i.as_py())
                dims.append(len(q))
                qs.append(q.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(qs, pa.binary())],
                names=["id", "dim", "q"])

    return df.select(F.col(id_col).cast("bigint"), F.col(vec_col)).mapInArrow(
        rows, "id bigint, dim int, q binary")


def digits(size: np.ndarray) -> np.ndarray:
    """Binary digits of non-negative integers below 2 ** 53 (0 has none)."""
    return np.frexp(size.astype(np.float64))[1].astype(np.int64)


class ImpactIndex:
    """Impact-ordered postings of one shard; ``x`` is an integer matrix, one row a vector.
    ``largest`` bounds the components of the queries."""

    def __init__(self, x: np.ndarray, largest: int):
        size = np.abs(x)
        sums = float(size.max(initial=0)) * largest * x.shape[1]        # bounds every sum below
        if sums >= 2.0 ** 62:
            raise OverflowError("scores must fit 64 bits")
        kind = np.float32 if sums < 2.0 ** 22 else np.float64 if sums < 2.0 ** 51 else np.int64
        self.least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        self.x, self.digits = x.astype(kind), digits(size)
        self.most = int(self.digits.max(initial=0))
        self.high = size.max(axis=0, initial=0)

    def segments(self, low: int, end: int) -> np.ndarray:
        """Postings with ``low`` to ``end - 1`` digits, a row for each dimension."""
        return np.where((self.digits >= low) & (self.digits < end), self.x, 0).T.copy()

    def top(self, queries: np.ndarray, k: int, own: np.ndarray):
        """For each query (rows, scores) of every possible member of its top k: all with a score
        at or above the k-th best, without row ``own`` (-1: none)."""
        step = max(1, TILE // max(1, len(self.x)))
        for at in range(0, len(queries), step):
            yield from self._tile(queries[at:at + step], k, own[at:at + step])

    def _tile(self, queries: np.ndarray, k: int, own: np.ndarray) -> list:
        n, kind = self.x.shape[0], self.x.dtype
        if n - 1 <= k:
            every = [np.flatnonzero(np.arange(n) != o) for o in own]
            return [(rows, self.x[rows] @ q) for rows, q in zip(every, queries.astype(kind))]
        found = [None] * len(queries)
        live = np.arange(len(queries))
        q, size = queries.astype(kind), np.abs(queries)
        a = digits(size)
        acc = np.zeros((len(q), n), kind)
        end = int(a.max(initial=0)) + self.most + 1
        for level in range(max(0, end - 2), -2, -2):
            level = max(level, 0)
            parts = [(d, max(1, level - d), min(self.most + 1, end - d)) for d in np.unique(a[a > 0]).tolist()]
            parts = [p for p in parts if p[1] < p[2]]
            if parts:
                acc += (np.concatenate([np.where(a == d, q, 0) for d, _, _ in parts], axis=1)
                        @ np.concatenate([self.segments(low, top) for _, low, top in parts]))
                mine = np.flatnonzero(own >= 0)
                acc[mine, own[mine]] = self.least
            end = level
            left = np.minimum((1 << np.clip(level - 1 - a, 0, 61)) - 1, self.high)
            rest = (size * left).sum(1)
            # no proof is near while more may come than the best one has
            tried = np.flatnonzero(rest <= acc.max(1)) if level else np.arange(len(q))
            done = np.zeros(len(q), bool)
            if len(tried):
                lead = np.argpartition(acc[tried], n - k, axis=1)[:, n - k:]
                exact = np.einsum("bkd,bd->bk", self.x[lead], q[tried])   # k exact scores: a proven bar
                bar = exact.min(1).astype(np.int64)
                may = acc[tried] >= (bar - rest[tried])[:, None].astype(kind)
                few = (may.sum(1) <= max(4 * k, RESCORE * n)) | (level == 0)
                for i in np.flatnonzero(few).tolist():
                    rows = np.flatnonzero(may[i])
                    scores = self.x[rows] @ q[tried[i]]
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    found[live[tried[i]]] = rows[keep], scores[keep]
                done[tried[few]] = True
            if done.all():
                break
            if done.any():
                live, q, size, a, acc, own = (z[~done] for z in (live, q, size, a, acc, own))
        return found


def top_k(df: DataFrame, queries, k: int = 20, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score) for the rows where the condition ``queries`` on the id
    column holds, against all rows."""
    vec = cut(quantise(df, id_col, vec_col, scale)
              .withColumn("uid", F.monotonically_increasing_id()), "quantised")
    asks = vec.filter(queries(F.col("id")))
    per = (vec.groupBy("dim").agg(F.count("*").alias("n"))
           .join(asks.groupBy("dim").agg(F.count("*").alias("nq")), "dim")
           .select("dim", "n", F.ceil(F.greatest(F.col("n") / SHARD, F.col("n") * F.col("dim") / SHARD_ENTRIES))
                   .cast("int").alias("shards"),
                   F.ceil(F.col("nq") / QUERIES).cast("int").alias("blocks")))
    per = cut(per, "vector-lengths")
    hot = heavy_keys(per, "dim", "n")
    h = F.xxhash64("uid")
    cand = split_join(vec, per.drop("n"), "dim", hot).select(
        "dim", "id", "uid", "q", F.lit(False).alias("asks"), F.pmod(h, "shards").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    ask = split_join(asks, per.drop("n"), "dim", hot).select(
        "dim", "id", "uid", "q", F.lit(True).alias("asks"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - F.lit(1).cast("bigint"))).alias("shard"),
        F.pmod(h, "blocks").cast("int").alias("block"))

    kinds = [("query_uid", pa.int64()), ("query_id", pa.int64()), ("cand_uid", pa.int64()),
             ("cand", pa.int64()), ("score", pa.int64())]

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim = int(t["dim"][0].as_py())
        mat = (lambda col: np.frombuffer(b"".join(col.to_pylist()), "<i8").reshape(len(col), dim))
        qs, cs = t.filter(t["asks"]), t.filter(pc.invert(t["asks"])).sort_by("uid")
        out = []
        if len(qs) and len(cs):
            x, y = mat(cs["q"]), mat(qs["q"])
            index = ImpactIndex(x, int(np.abs(y).max(initial=0)))
            # ids stay integers beside missing ones, which come last
            ids, none = cs["id"].fill_null((1 << 63) - 1).to_numpy(), cs["id"].is_null().to_numpy()
            uid = cs["uid"].to_numpy()
            place = {u: i for i, u in enumerate(uid.tolist())}
            own = np.array([place.get(u, -1) for u in qs["uid"].to_pylist()], np.int64)
            for u, name, (rows, score) in zip(qs["uid"].to_pylist(), qs["id"].to_pylist(), index.top(y, k, own)):
                score = score.astype(np.int64)
                best = np.lexsort((uid[rows], ids[rows], none[rows], -score))[:k]
                n, at = len(best), rows[best]
                out.append([pa.array([u] * n, pa.int64()), pa.array([name] * n, pa.int64()), pa.array(uid[at]),
                            cs["id"].take(pa.array(at)).combine_chunks(), pa.array(score[best])])
        return pa.table([pa.chunked_array([o[c] for o in out], kind) for c, (_, kind) in enumerate(kinds)],
                        names=[n for n, _ in kinds])

    found = (cand.unionByName(ask).groupBy("dim", "shard", "block").applyInArrow(
        search, "query_uid bigint, query_id bigint, cand_uid bigint, cand bigint, score bigint"))
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("cand"), "cand_uid")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("cand").alias(id_col), "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    WHERE a.vec_id % 20 = 0))
WHERE rank <= 20
"""
