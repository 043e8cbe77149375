"""Operator 13 against a dense eigensolver and exact integers."""

import math

import numpy as np
import pytest

from txgraph.llm import whitening as W


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr(
        "*", "'o' AS id", "'o' AS x", "'o' AS n", "1 AS component")


def brute(rows, wanted=16):
    ok = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in ok}), np.float64)
    n, s = len(fit), [int(t) for t in fit.sum(axis=0)]
    y = fit - np.array(s) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    return ok, n, s, e, q, np.trace(y.T @ y / n)


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_components_of_any_spectrum(d):
    rnd = np.random.default_rng(d)
    u = np.linalg.qr(rnd.standard_normal((d, d)))[0]
    for values in (rnd.random(d), np.r_[np.ones(d // 2), np.zeros(d - d // 2)], np.geomspace(1, 1e-9, d), np.ones(d) * 3,
                   np.arange(d) // 7 + 1.0):
        v = (u * values) @ u.T
        v = (v + v.T) / 2
        e, q = W.components(v, 16)
        want = np.sort(values)[::-1]
        want = want[want > W.ROUNDING * d * want.sum()][:16]
        assert len(e) == len(want) and np.allclose(e, want, rtol=1e-6, atol=1e-13 * want.max(initial=0))
        assert np.allclose(q.T @ q, np.eye(len(e)), atol=1e-12)
        assert np.abs(v @ q - q * e).max(initial=0) <= 1e-12 * want.max(initial=1)
    diag, off = W.tridiagonal(v)
    for t in rnd.random(10) * 8:
        assert W.count_above(diag, off, t) == (np.linalg.eigvalsh(v) > t).sum()


def test_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    base = (rnd.standard_normal((300, 24)) * np.linspace(2, 0.1, 24)) @ rnd.standard_normal((24, 24)) / 5
    rows = [(int(k), [float(c) for c in base[k % 300]]) for k in range(400)]        # repeated vectors
    rows += [(None, rows[0][1]), ((1 << 53) + 1, rows[1][1]), (5, rows[2][1]), (900, None), (901, []),
             (902, [None] + [0.0] * 23), (903, [float("nan")] * 24), (904, [float("inf")] * 24)]
    got = W.whiten(vectors(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ok, n, s, e, q, trace = brute(rows)
    out = got.collect()
    assert len(out) == 16 * len(ok)
    mine = {}
    for r in out:
        mine.setdefault((r.vec_id, r.deviation), []).append(r)
    dev = {}
    for i, x in ok:
        dev[i, sum((n * a - t) ** 2 for a, t in zip(x, s))] = x
    assert set(mine) == set(dev)
    sign = None
    for key, x in dev.items():
        rs = sorted(mine[key], key=lambda r: r.component)[:16]
        assert [r.component for r in rs] == list(range(1, 17)) or len(mine[key]) > 16
        rs = {r.component: r for r in mine[key]}
        w = np.array([rs[k].whitened for k in range(1, 17)])
        want = (np.array(x) - np.array(s) / n) @ q / np.sqrt(e)
        sign = np.sign(w * want) if sign is None else sign
        assert np.allclose(w * sign, want, atol=1e-7)
        assert all(r.n == n and 0 <= r.identity_error < 1e-9 for r in rs.values())
        assert np.allclose([rs[k].explained for k in range(1, 17)], e / trace, rtol=1e-9)


def test_edge_cases(spark):
    assert W.whiten(vectors(spark, [])).count() == 0
    assert W.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert W.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0      # one vector
    flat = W.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, -1.0]), (3, [0.5]), (4, [1e30, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 9))) for r in flat) == [
        (1, 1, 2, 128 ** 2, 1.0), (2, 1, 2, 128 ** 2, 1.0)]
    # wide entries: exact deviations beyond 53 bits, null beyond a long
    rows = [(k, [float(1 << 20) * k, 1.0]) for k in range(6)]
    _, n, s, *_ = brute(rows)
    far = {r.vec_id: r.deviation for r in W.whiten(vectors(spark, rows)).collect()}
    assert far == {k: (n * (64 * (1 << 20) * k + 1_000_000) - s[0]) ** 2 for k in range(6)}
    big = W.whiten(vectors(spark, [(k, [float(1 << 40) * k, 1.0]) for k in range(6)])).collect()
    assert big and all(r.deviation is None for r in big)
