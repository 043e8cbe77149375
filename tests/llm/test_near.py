"""Operators 6, 8 and 4 against brute force."""

import random

import numpy as np
import pytest
from cases import documents, empty

from txgraph.llm import setsketch as S


def brute_components(n, links):
    lab = list(range(n))

    def find(x):
        while lab[x] != x:
            lab[x] = lab[lab[x]]
            x = lab[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        lab[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_near(rows, percent=85):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for j in range(len(rows)) for i in range(j)
             if sets[i] and sets[j] and (100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
                                         or rows[i][0] is not None and rows[i][0] == rows[j][0])
             and rows[i][0] is not None and rows[j][0] is not None]
    comp = brute_components(len(rows), links)
    least = {}
    for c, (d, _) in zip(comp, rows):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, len(s), least.get(c) if d is not None else None,
                    d is None or least[c] == d)
                   for (d, _), s, c in zip(rows, sets, comp)), key=repr)


def near_rows():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    base = [rnd.choice(vocab) for _ in range(150)]
    for i in range(120):                       # one dense group around the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
    for i in range(40):                        # chains: each a small change of the last
        w = [rnd.choice(vocab) for _ in range(60)]
        for k in range(4):
            rows.append((3000 + 10 * i + k, " ".join(w)))
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
    return rows + [(500 + i, rows[0][1].upper()) for i in range(30)]


def test_near_duplicates(spark):
    rows = near_rows() + [(r.doc_id, r.text) for r in documents(spark, extra=False).collect()]
    df = documents(spark, rows)
    got = sorted(map(tuple, S.near_duplicates(df).collect()), key=repr)
    want = brute_near(rows)
    assert got == want
    assert S.near_duplicates(empty(spark)).count() == 0


def test_blocks_and_small_parts_agree(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "SMALL", 2)
    monkeypatch.setattr(S, "PER_COPY", 5)
    rows = near_rows()
    got = sorted(map(tuple, S.near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert got == brute_near(rows)


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2 ** 63, 3000, dtype=np.uint64))
    a, b = x[:2000], x[1000:]
    union = S.registers(np.union1d(a, b))
    assert (S.merge(S.registers(a), S.registers(b)) == union).all()
    one = lambda z: z[None, :]
    n = lambda z: np.array([len(z)])
    ra, rb = one(S.registers(a)), one(S.registers(b))
    assert not S.may_link(ra, rb, n(a), n(b), 0.85)[0]
    c = x[:1900]
    assert S.may_link(ra, one(S.registers(c)), n(a), n(c), 0.85)[0]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").selectExpr(
        "*", "1 AS node", "2 AS g", "3 AS id", "4 AS unit", "5 AS score", "6 AS rank")


def vector_rows(dim=16):
    rng = np.random.default_rng(2)
    rows = []
    for label, n in (("a", 500), ("b", 60)):
        x = rng.standard_normal((n, dim))
        x[: n // 3] = x[0] + 0.05 * rng.standard_normal((n // 3, dim))       # a dense group
        x[n // 2] = x[n // 2 + 1] * 2 + 0.001
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate(x)]
    rows += [(9000 + i, rows[0][1], "a") for i in range(20)]                 # copies
    return rows + [(9100, None, "a"), (9101, [], "a"), (9102, [0.0] * dim, "a"), (9103, [1.0, None], "a"),
                   (9104, [float("nan")] * dim, "a"), (9105, rows[0][1], None), (9106, rows[0][1][:8], "a"),
                   (9107, [1e200] * dim, "b"), (9108, [1e200] * dim, "b"), (None, rows[3][1], "a")]


def brute_vectors(rows, t=0.98):
    def usable(v, lab):
        return (lab is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0))

    unit = [np.array(v) / max(np.abs(v)) if usable(v, lab) else None for _, v, lab in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [(i, j) for j in range(len(rows)) for i in range(j)
             if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    comp = brute_components(len(rows), links)
    least = {}
    for c, r in zip(comp, rows):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0], k, least.get(c), r[0] is None or r[0] == least[c])
                   for r, k, c in zip(rows, n, comp)), key=repr)


@pytest.mark.parametrize("recall", [0.95, 2.0])
def test_vector_near_duplicates(spark, recall, monkeypatch):
    """Also with a recall that no audit reaches, which compares the labels whole."""
    from txgraph.llm import nn_descent as N

    monkeypatch.setattr(N, "ATTEMPTS", 1)
    monkeypatch.setattr(N, "BLOCK", 64)
    rows = vector_rows()
    got = sorted(map(tuple, N.vector_near_duplicates(vectors(spark, rows), recall=recall).collect()), key=repr)
    assert got == brute_vectors(rows)


def rare_links(n=6000, dim=16):
    """A narrow cone in which only every hundredth vector has a link, to one other."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((n, dim))
    x[:, 0] += 2
    for i in range(0, n, 100):
        z = rng.standard_normal(dim)
        u = x[i] / np.linalg.norm(x[i])
        z -= (z @ u) * u
        x[i + 1] = 0.982 * u + np.sqrt(1 - 0.982 ** 2) * z / np.linalg.norm(z)
    return [(i, v.tolist(), "a") for i, v in enumerate(x)]


def test_rare_links_in_a_cone(spark, monkeypatch):
    """Blocks far over their size, and an audit that meets few links."""
    from txgraph.llm import nn_descent as N

    monkeypatch.setattr(N, "BLOCK", 64)
    rows = rare_links()
    got = sorted(map(tuple, N.vector_near_duplicates(vectors(spark, rows)).collect()), key=repr)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = [(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.98)) if i < j]
    comp = brute_components(len(rows), near)
    n = np.bincount(np.array(near).ravel(), minlength=len(rows))
    assert got == sorted(((i, int(n[i]), comp[i], comp[i] == i) for i in range(len(rows))), key=repr)


def test_audit_without_links_is_no_proof(spark, monkeypatch):
    """Too few tables are noticed where no vector has a link."""
    from txgraph.llm import nn_descent as N

    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(rng.standard_normal((400, 64)))]
    df = N.cut(N.prepare(vectors(spark, rows), "vec_id", "embedding", "label")
               .withColumn("node", N.F.monotonically_increasing_id())
               .withColumn("g", N.F.lit(1).cast("bigint")))
    none = spark.createDataFrame([], "u bigint, v bigint, sim double")
    groups = spark.createDataFrame([(1, 400, 16, 1)], "g bigint, size bigint, bits int, tables int")
    monkeypatch.setattr(N, "AUDIT_MOST", 64)
    assert N._recall(df, groups, none, 1, 0.98) < 0.6
    assert N._recall(df, groups, none, 20, 0.98) > 0.95


def test_whole_labels_return_no_pairs(spark, monkeypatch):
    """Blocks of a dense group return a forest and counts, not its 19,900 pairs."""
    from txgraph.llm import nn_descent as N

    monkeypatch.setattr(N, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + 0.01 * rng.standard_normal(8)).tolist(), "a") for i in range(200)]
    classes = (N.prepare(vectors(spark, rows), "vec_id", "embedding", "label")
               .selectExpr("id AS node", "1L AS copies", "dim", "unit"))
    sizes = spark.createDataFrame([(1, 200)], "comp bigint, n bigint")
    out = N._compare_blocks(classes.selectExpr("node", "1L AS comp"), sizes, classes, 0.98, forest=True).toPandas()
    blocks = 4 * 5 // 2                                   # four parts, each pair once
    edges = out[out.other.notna()]
    assert 199 <= len(edges) < blocks * 2 * 64
    assert (out[out.links.notna()].groupby("node").links.sum() == 199).all()
    assert len(set(brute_components(200, list(zip(edges.node.astype(int), edges.other.astype(int)))))) == 1


def test_vectors_empty(spark):
    from txgraph.llm import nn_descent as N

    assert N.vector_near_duplicates(vectors(spark, vector_rows()).limit(0)).count() == 0


@pytest.mark.parametrize("shard,block", [(16384, 512), (50, 7)])
def test_top_k(spark, monkeypatch, shard, block):
    from txgraph.llm import topk as T

    monkeypatch.setattr(T, "SHARD", shard)
    monkeypatch.setattr(T, "QUERIES", block)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) / 3).tolist(), "x") for i in range(300)]
    rows += [(300 + i, rows[20][1], "x") for i in range(30)]                  # ties
    rows += [(20, rows[40][1], "x"), (400, None, "x"), (401, [1.0, None], "x"), (420, [float("inf")] * 8, "x"),
             (440, [0.5] * 3, "x"), (441, [0.25] * 3, "x"), (None, [0.1] * 8, "x"), (460, [], "x")]
    got = sorted(map(tuple, T.top_k(vectors(spark, rows), lambda c: c % 20 == 0).collect()), key=repr)
    q = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v, _ in rows
         if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (i, x) in enumerate(q):
        if i is not None and i % 20 == 0:
            s = sorted((-int(x @ y), j is None, j if j is not None else 0, b)
                       for b, (j, y) in enumerate(q) if b != a and len(y) == len(x))
            want += [(i, r + 1, None if m else j, -v) for r, (v, m, j, _) in enumerate(s[:20])]
    assert got == sorted(want, key=repr)
    assert T.top_k(vectors(spark, rows).limit(0), lambda c: c % 20 == 0).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 7, 64])
@pytest.mark.parametrize("scale", [1, 3, 64, 10**6, 10**8])
def test_impact_index(dim, scale, monkeypatch):
    """Every possible member and its exact score, in single, double and integer sums, in tiles."""
    from txgraph.llm import topk as T

    monkeypatch.setattr(T, "TILE", 2000)
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale + 1, (300, dim))
    x[100:140], x[200] = x[100], 0
    own = np.arange(-5, 40).clip(-1)
    asked = np.concatenate([x[150:155], x[:40]])
    for q, o, (rows, scores) in zip(asked, own, T.ImpactIndex(x, scale).top(asked, 20, own)):
        others = np.arange(300) != o
        exact = x @ q
        want = others & (exact >= np.sort(exact[others])[-20])
        assert sorted(rows.tolist()) == np.flatnonzero(want).tolist()
        assert (exact[rows] == scores.astype(np.int64)).all()
    with pytest.raises(OverflowError):
        T.ImpactIndex(x * 10**9, 2 * 10**10 * scale)


def test_top_k_keeps_large_ids_beside_missing_ones(spark):
    from txgraph.llm import topk as T

    big = 1 << 53
    rows = [(big + k, [float(k), 1.0], 0) for k in (1, 3, 5, 7)] + [(None, [9.0, 1.0], 0), (None, [0.5, 1.0], 0), (20, [1.0, 0.0], 0)]
    got = T.top_k(vectors(spark, rows), lambda c: c == 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [None, big + 7, big + 5, big + 3, big + 1, None]
