"""Operator 13, embedding whitening by FEAST contour integration.

Spark does what grows with the rows: the distinct integer vectors, their exact sums, their
covariance (each task centres its vectors and adds up ``d x d`` products, the partial matrices are
added row by row), the projection of all rows and the covariance of the whitened vectors. The
driver holds ``d x d`` numbers, of dimensions and not of rows, and finds the leading components:

1. inertia: Householder reflections bring the covariance to tridiagonal form; the signs of the
   pivots of ``T - s I`` say how many eigenvalues lie above ``s``. Bisection on these counts cuts
   the upper spectrum into intervals of few eigenvalues each, with ends clear of them;
2. per interval, Gauss-Legendre quadrature of ``(z I - V)^-1 Q`` over the upper half of the circle
   through its ends (the lower half is the conjugate) filters a random block ``Q`` down to
   the interval's eigenspace;
3. Rayleigh-Ritz in that subspace gives eigenvalues and vectors, refined by the same again until
   residuals reach rounding;
4. as many Ritz values as the inertia count says must lie in the interval; a larger block is
   taken otherwise, so none is missed.

Defined results. Entry ``c`` becomes ``floor(64 c) + 1000000``. Vectors that are null, empty, hold
null or non-finite entries, or entries whose product exceeds ``2 ** 52``, take no part; of vectors of
several lengths only those of the most frequent length do (ties: the longer). The fit list is each
distinct integer vector once. Components with an eigenvalue of rounding size (below ``d * 1e-13`` of
the trace) cannot be whitened and give no rows: none at all for one distinct vector. Equal
eigenvalues come in any basis of their space, the same for all rows. A deviation beyond a long is
null. Null and repeated ids are rows like others; other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm.common import cut, ship

COMPONENTS = 16
SHIFT = 1_000_000
SCALE = 64
NODES = 8
IN_INTERVAL = 4
ROUNDING = 1e-13
_TOP = 1 << 63


# --- the spectrum of one symmetric matrix (driver, d x d) -------------------------

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal matrix with the eigenvalues of ``v``."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        low = a[k + 1:, k:]
        low -= 2 * np.outer(x, x @ low)
        right = a[k:, k + 1:]
        right -= 2 * np.outer(right @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(diag: np.ndarray, off: np.ndarray, s: float) -> int:
    """Eigenvalues above ``s``, by the inertia of the shifted tridiagonal matrix."""
    above, pivot = 0, 1.0
    tiny = np.finfo(float).tiny
    for k in range(len(diag)):
        pivot = diag[k] - s - (off[k - 1] ** 2 / pivot if k else 0.0)
        if pivot == 0.0:
            pivot = -tiny
        above += pivot > 0
    return above


def intervals(diag: np.ndarray, off: np.ndarray, lowest: float, wanted: int, most: int):
    """(low, high, count) from the top down, covering ``wanted`` eigenvalues above ``lowest`` or all
    there are. ``most`` to an interval, unless they lie too close to be parted."""
    radius = float(np.max(np.abs(diag) + np.r_[np.abs(off), 0] + np.r_[0, np.abs(off)]))
    high, above, out = radius * (1 + 1e-9) + 1e-300, 0, []
    wanted = min(wanted, count_above(diag, off, lowest))
    gap = 1e-11 * radius
    while above < wanted:
        lo, hi = lowest, high
        aim = min(above + most, wanted)
        # the greatest known end with ``aim`` eigenvalues or more above it: hi tends to the aim-th
        while hi - lo > gap:
            mid = (lo + hi) / 2
            if count_above(diag, off, mid) >= aim:
                lo = mid
            else:
                hi = mid
        # step down to an end in a gap between eigenvalues
        low, n = lo, count_above(diag, off, lo)
        nxt = n + 1
        a, b = lowest, low
        if count_above(diag, off, lowest) >= nxt:
            while b - a > gap:
                mid = (a + b) / 2
                if count_above(diag, off, mid) >= nxt:
                    a = mid
                else:
                    b = mid
            low = (low + b) / 2
        else:
            low = lowest
        n = count_above(diag, off, low)
        out.append((low, high, n - above))
        high, above = low, n
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 7, nodes: int = NODES):
    """The ``count`` eigenpairs of ``v`` in ``(low, high)``, values falling."""
    d = len(v)
    scale = float(np.abs(v).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(nodes)
    angle = np.pi / 2 * (x + 1)
    z = centre + radius * np.exp(1j * angle)
    rnd = np.random.default_rng(seed)
    size = min(d, count + max(4, count))
    while True:
        q = np.linalg.qr(rnd.standard_normal((d, size)))[0]
        last = np.inf
        for _ in range(40):
            # half the contour: the lower half adds the complex conjugate
            y = sum((w[k] / 2) * np.real(radius * np.exp(1j * angle[k]) *
                                         np.linalg.solve(z[k] * np.eye(d) - v, q)) for k in range(nodes))
            q = np.linalg.qr(y)[0]
            small = q.T @ v @ q
            value, turn = np.linalg.eigh((small + small.T) / 2)
            q = q @ turn
            inside = (value > low) & (value < high)
            residual = np.linalg.norm(v @ q - q * value, axis=0)
            worst = residual[inside].max() if inside.any() else np.inf
            if inside.sum() == count and (worst <= 1e-14 * scale * d ** 0.5 or worst >= last / 2 and worst < 1e-11 * scale):
                by = np.flatnonzero(inside)[::-1]
                return value[by], q[:, by]
            last = min(last, worst)
        if size == d:
            raise ArithmeticError(f"{count} eigenvalues in ({low}, {high}) by inertia, {inside.sum()} found")
        size = min(d, 2 * size)


def components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding size and their unit vectors in columns."""
    trace = float(np.trace(v))
    lowest = ROUNDING * len(v) * trace
    if not len(v) or not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scaled = v / trace                  # so that no shift underflows
    diag, off = tridiagonal(scaled)
    values, vectors = [], []
    for k, (low, high, count) in enumerate(intervals(diag, off, lowest / trace, wanted, IN_INTERVAL)):
        if count:
            e, q = feast(scaled, low, high, count, seed=k)
            values.append(e)
            vectors.append(q)
    if not values:
        return np.zeros(0), np.zeros((len(v), 0))
    e, q = np.concatenate(values), np.concatenate(vectors, axis=1)
    q = np.linalg.qr(q)[0]              # orthogonal across intervals to the last digit
    e = np.einsum("ij,ij->j", q, scaled @ q)
    by = np.argsort(-e, kind="stable")[:wanted]
    return e[by] * trace, q[:, by]


# --- the rows (Spark) -------------------------------------------------------------

def _matrix(col, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), d)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): the rows that take part, with their integer vectors."""
    c = F.col(vec_col).cast("array<double>")
    ok = c.isNotNull() & (F.size(c) > 0) & F.forall(
        c, lambda v: F.coalesce(F.abs(v * SCALE) <= float(1 << 52), F.lit(False)) & ~F.isnan(v))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("bigint") + SHIFT)
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("id"), x.alias("x"))


def _sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors and their exact sums (Python integers)."""
    def add(batches):
        n, total = 0, [0] * d
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), d)
                # 52 bits an entry and 10,000 rows a batch may pass a long: two halves
                hi, lo = (m >> 26).sum(axis=0), (m & ((1 << 26) - 1)).sum(axis=0)
                total = [t + (int(h) << 26) + int(s) for t, h, s in zip(total, hi, lo)]
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], pa.list_(pa.string()))],
                                         names=["n", "s"])

    rows = fit.select("x").mapInArrow(add, "n bigint, s array<string>")
    r = rows.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    s = np.zeros(d, object)
    for x in r:
        s[x.i] = int(x.s)
    return (int(r[0].n) if r else 0), s


def _moments(fit: DataFrame, width: int, move) -> np.ndarray:
    """Sum over the fit list of the products ``y y^T`` of ``y = move(x)``: ``width`` rows a task,
    added up by Spark. The last row is the sum of ``y``."""
    def add(batches):
        total = np.zeros((width + 1, width))
        for b in batches:
            if b.num_rows:
                y = move(b.column(0))
                total[:width] += y.T @ y
                total[width] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
            names=["i", "row"])

    rows = fit.select("x").mapInArrow(add, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width + 1, width))
    for r in cells.collect():       # (width + 1) * width numbers
        out[r.i, r.j] = r.v
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           wanted: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each
    remaining row and component."""
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    rows = cut(integer_vectors(df, id_col, vec_col), "integer-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d = lengths.d
    rows = rows.filter(F.size("x") == d)
    fit = cut(rows.select("x").distinct(), "fit-list")
    n, s = _sums(fit, d)
    mean = np.array([float(t) / n for t in s])
    # x - S/n with the whole part of the mean taken off in integers
    whole = np.array([int(t) // n for t in s], np.int64)
    rest = np.array([(int(t) % n) / n for t in s])

    def centred(col):
        return (_matrix(col, d) - whole).astype(np.float64) - rest

    m = _moments(fit, d, centred)
    off_mean = m[d] / n                        # what rounding left of the mean
    v = m[:d] / n - np.outer(off_mean, off_mean)
    v = (v + v.T) / 2
    e, q = components(v, wanted)
    k = len(e)
    if not k:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    turn = q / np.sqrt(e)
    m = _moments(fit, k, lambda col: (centred(col) - off_mean) @ turn)
    cov = m[:k] / n - np.outer(m[k] / n, m[k] / n)
    error = float(np.abs(cov - np.eye(k)).max())
    explained = e / float(np.trace(v))
    sums = [int(t) for t in s]
    narrow = abs(mean).max() * n * 4 < _TOP    # n x - S fits a long for all that is near the mean

    def project(batches):
        sa = np.array(sums, np.int64) if narrow else None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), d)
            w = centred(b.column(1)) @ turn
            near = (np.abs(x - mean).max(axis=1) * n * np.sqrt(d) < 2.9e9)    # squares add up below 2^63
            dev = [None] * len(x)
            if narrow and near.any():
                at = np.flatnonzero(near)
                t = x[at] * n - sa
                for i, y in zip(at, (t * t).sum(axis=1).tolist()):
                    dev[i] = y
                rest_ = np.flatnonzero(~near)
            else:
                rest_ = range(len(x))
            for i in rest_:
                y = sum((n * a - c) ** 2 for a, c in zip(x[i].tolist(), sums))
                dev[i] = y if y < _TOP else None
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n)), pa.array(dev, pa.int64()).take(at), pa.array(w.ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)
