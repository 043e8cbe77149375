"""Physical-plan properties the engine relies on at scale (checked with explain)."""

import os

import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "triangles", "local_clustering", "global_clustering", "transitivity", "connected_components",
    "label_propagation", "cluster_links", "modularity_standard", "graph_report", "blocks_ingest",
    "snowball_sample", "assign_ids", "dedup_last_wins", "block_range_sample",
])
def test_no_cross_join_or_python(spark, name):
    from __spark_entry__ import queries

    plan = _plan(queries()[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad} in plan"


def test_scan_reads_only_what_edges_need(spark):
    from txgraph.plans import fixtures as fx

    plan = _plan(fx.monthly_edges(spark, SF))
    for col in ("l_tax", "l_comment", "l_returnflag", "o_totalprice"):
        assert col not in plan


@pytest.fixture
def shuffled(spark):
    """Plans as a cluster runs them: no join is small enough to broadcast by itself."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_label_rounds_follow_the_changed_labels(spark):
    """Maintained histograms equal those counted anew, and what a round sends shrinks."""
    from pyspark.sql import functions as F

    from txgraph.operators import community as CM
    from txgraph.operators.views import vertex_ids
    from txgraph.operators.written import write
    from txgraph.plans import fixtures as fx

    e, _ = write(fx.monthly_edges(spark, SF))
    w, _ = write(CM.message_weights(e))
    labels = {r.id: r.id for r in vertex_ids(e).collect()}
    weights = [tuple(r) for r in w.collect()]
    changes, sent, moved = [], [], None
    for step in range(4):
        hist = {}
        for f, t, n in weights:
            hist[t, labels[f]] = hist.get((t, labels[f]), 0) + n
        if step:
            change, rows = write(CM.histogram_change(w, moved))
            sent.append(rows)
            changes.append(change)
            got = {(r.t, r.label): r.n for r in CM.touched_histograms(w, changes).collect()}
            touched = {t for t, _ in got}
            assert got == {k: n for k, n in hist.items() if k[0] in touched}
        best = {}
        for (t, label), n in hist.items():
            best[t] = min(best.get(t, (0, 0)), (-n, label))
        new = {v: best[v][1] if v in best else x for v, x in labels.items()}
        moved = spark.createDataFrame([(v, labels[v], x) for v, x in new.items() if x != labels[v]],
                                      "id bigint, old bigint, label bigint")
        labels = new
        assert labels == {r.id: r.label for r in CM.label_propagation(e, step).collect()}
    assert sent[-1] < sent[0]
    round_ = CM.histogram_change(w, moved.join(F.broadcast(moved.limit(1).select("id")), "id"))
    assert "Exchange hashpartitioning(f" not in _plan(round_)


def test_hub_is_split_in_contraction_rounds(shuffled):
    """A hub with a third of all edges: the joins of a round are between plain shuffles, so the
    adaptive split deals the hub's rows; the edge table shrinks; the result is exact."""
    from pyspark.sql import functions as F

    from txgraph.operators import components as CC
    from txgraph.operators.build import induced_edges
    from txgraph.session import cut_table

    spark = shuffled
    n = 60_000
    pairs = cut_table(
        spark.range(1, n // 3).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
        .unionByName(spark.range(n, 3 * n, 3).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        .unionByName(spark.range(4 * n, 4 * n + 500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))))
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        r = cut_table(CC.followed(cut_table(CC.nearest(pairs, 11)), 11))
        left = CC.contracted(pairs, r)
        assert 0 < len(left.collect()) < 400
        assert "skew=true" in _plan(left)
        comps = CC.connected_components(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        sizes = {r.component: r.size for r in CC.component_sizes(comps).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sizes[0] == n // 3 and set(sizes.values()) == {n // 3, 2, 501}
    e = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    assert induced_edges(e, spark.range(0, n // 3)).count() == n // 3 - 1


@pytest.mark.parametrize("shape", ["path", "down", "mixed", "star", "tree", "clique", "random"])
def test_components_of_any_shape(spark, shape):
    """Against a plain union-find, with repeated edges, loops and missing ends."""
    import random

    from txgraph.operators import components as CC

    rnd = random.Random(len(shape))
    n = 400
    pairs = {
        "path": [(i, i + 1) for i in range(n)], "down": [(n - i, n - i - 1) for i in range(n)],
        "mixed": [(x, y) for p in [rnd.sample(range(n), n)] for x, y in zip(p, p[1:])],
        "star": [(7, i) for i in range(n)], "tree": [(i, i // 2) for i in range(1, n)],
        "clique": [(i, j) for i in range(25) for j in range(i)],
        "random": [(rnd.randrange(-n, n), rnd.randrange(-n, n)) for _ in range(n)],
    }[shape]
    rows = pairs + pairs[:5] + [(9_000, 9_000), (9_001, None), (None, 9_002), (None, None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in rows:
        x, y = (y if x is None else x), (x if y is None else y)
        if x is not None:
            a, b = find(x), find(y)
            up[max(a, b)] = min(a, b)
    got = CC.connected_components(spark.createDataFrame(rows, "src bigint, dst bigint")).collect()
    assert len(got) == len(up)
    assert {r.id: r.component for r in got} == {x: find(x) for x in up}


def test_shuffled_plans_agree_with_broadcast_ones(shuffled):
    """Wedges, labels and label pairs, with automatic broadcasts off and skew split eagerly."""
    from txgraph.operators import community as CM
    from txgraph.operators import triangles as T
    from txgraph.plans import fixtures as fx
    from txgraph.session import cut_table

    spark = shuffled
    e = cut_table(fx.dense_edges(spark, SF))
    groups = cut_table(e.selectExpr("src AS id").union(e.selectExpr("dst AS id")).distinct()
                       .selectExpr("id", "id % 7 AS label"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    work = {"triangles": lambda: T.triangles(e), "per vertex": lambda: T.vertex_triangles(e),
            "from a listing": lambda: T.vertex_triangles(e, T.triangles(e)),
            "labels": lambda: CM.label_propagation(e, 3), "pairs": lambda: CM.label_pairs(e, groups)}
    eager = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    plain = {k: rows(f()) for k, f in work.items()}
    old = {k: spark.conf.get(k) for k in eager}
    for k, v in eager.items():
        spark.conf.set(k, v)
    try:
        split = {k: rows(f()) for k, f in work.items()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    sent = {k: rows(f()) for k, f in work.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plain == split == sent
    assert plain["per vertex"] == plain["from a listing"] and len(plain["triangles"]) == 26609


def test_trimming_keeps_all_triangles(spark):
    """Chains and trees hanging off triangles are trimmed away, over several rounds."""
    from txgraph.operators import triangles as T

    tri = [(3 * k, 3 * k + 1) for k in range(9)] + [(3 * k + 1, 3 * k + 2) for k in range(9)] + [
        (3 * k + 2, 3 * k) for k in range(9)]
    tails = [(3 * k if j == 0 else 1000 + 50 * k + j, 1001 + 50 * k + j) for k in range(9) for j in range(40)]
    e = spark.createDataFrame(tri + tails, "src bigint, dst bigint")
    assert T.triangle_total(e).first()[0] == 9
    assert {r.id: r.t for r in T.vertex_triangles(e).collect()} == {k: 1 for k in range(27)}
    o = T.oriented_edges(spark.createDataFrame([(k, k + 1) for k in range(3)] + [(10, k) for k in range(20, 40)],
                                               "src bigint, dst bigint"))
    assert o.count() <= 1


def test_wedges_travel_as_one_row_an_edge(spark):
    """An edge carries its wedges in one array; the exploded rows are shuffled, never broadcast."""
    from txgraph.operators import triangles as T

    n = 40
    clique = spark.createDataFrame([(i, j) for i in range(n) for j in range(i)], "src bigint, dst bigint")
    near = {r.u: r.up for r in T.upper_neighbours(T.oriented_edges(clique)).collect()}
    assert near == {u: list(range(u + 1, n)) for u in range(n - 1)}
    found = T.closed_wedges(clique)
    plan = _plan(found)
    assert "Exchange hashpartitioning(v#" in plan and ", w#" not in plan.split("Exchange", 1)[1]
    assert "Broadcast" not in plan
    assert sorted(map(tuple, found.collect())) == [
        (u, v, w) for u in range(n) for v in range(u + 1, n) for w in range(v + 1, n)]


def test_top_k_per_address_limits_before_shuffle(spark):
    from txgraph.operators.sample import incidence_top
    from txgraph.plans import fixtures as fx

    plan = incidence_top(fx.transactions(spark, SF), 5)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedup_is_partial_aggregate(spark):
    from txgraph.operators.sample import dedup_last_wins
    from txgraph.plans import fixtures as fx

    plan = dedup_last_wins(fx.transactions(spark, SF))._jdf.queryExecution().sparkPlan().toString()
    assert "partial_min" in plan


def test_queries_name_what_exists():
    """Every registered query's code, its helpers included, refers to names of its module."""
    import builtins
    import dis
    import types

    from txgraph.plans import catalog

    def named(code):
        for c in code.co_consts:
            if isinstance(c, types.CodeType):
                yield from named(c)
        yield from (i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL")

    for query, fn in catalog.QUERIES.items():
        todo, seen = [fn], set()
        while todo:
            f = todo.pop()
            for n in named(f.__code__):
                assert hasattr(catalog, n) or hasattr(builtins, n), f"{query}: {n} is not defined"
                g = getattr(catalog, n, None)
                if isinstance(g, types.FunctionType) and g.__module__ == catalog.__name__ and n not in seen:
                    seen.add(n)
                    todo.append(g)


def test_hard_lines_read_the_table_once(spark):
    from txgraph.plans import fixtures as fx
    from txgraph.plans import payloads as P

    plan = P.hard_v2_lines(fx.transactions(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


def test_stream_bases_stay_in_proportion(spark, tmp_path):
    """Eight triggers rewrite the base as it doubles (1, 3, 7), not every second time."""
    from txgraph.streaming.blocks import read_stream_blocks, stream_blocks

    for i in range(8):
        (spark.range(1).selectExpr(
            f"""'{{"result":{{"number":"0x{i}","transactions":[{{"hash":"0x{i}a","from":"0x1","to":"0x2",'"""
            """ || '"value":"0x5"}]}}' AS value""").coalesce(1).write.mode("append").text(f"{tmp_path}/in"))
    stream_blocks(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state",
                  max_files_per_trigger=1, compact=2).awaitTermination()
    assert sorted(os.listdir(f"{tmp_path}/out/base")) == ["upto=1", "upto=3", "upto=7"]
    assert read_stream_blocks(spark, f"{tmp_path}/out").count() == 8


def test_snowball_states_are_written_tables(spark):
    """Spark knows the size of a hop's state, so a small frontier is broadcast."""
    from txgraph.plans.catalog import QUERIES

    plan = _plan(QUERIES["snowball_sample"](spark, SF))
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_incidence_is_written_from_the_bands(spark, monkeypatch):
    """the transactions are not joined again for the index."""
    from txgraph.plans.catalog import QUERIES
    from txgraph.sources import store as ST

    seen, write = [], ST.write_incidence
    monkeypatch.setattr(ST, "write_incidence", lambda tx, *a: (seen.append(_optimized(tx)), write(tx, *a)))
    QUERIES["snowball_indexed"](spark, SF)
    assert len(seen) == 1 and "l_orderkey" not in seen[0]


def test_export_reads_written_edges(spark):
    """vertices and edge lines come from one written table, not from three joins."""
    from txgraph.plans.catalog import QUERIES

    assert "l_orderkey" not in _optimized(QUERIES["gexf_lines"](spark, SF))


def test_rounds_do_not_coalesce_joins(spark, monkeypatch):
    """no task of a round runs the sorts of many partitions one after the other."""
    from txgraph.operators import components as CC
    from txgraph.operators import written

    seen, cut_table = [], written.cut_table
    monkeypatch.setattr(written, "cut_table", lambda df: (seen.append(_optimized(df)), cut_table(df))[1])
    e = spark.range(50).selectExpr("id AS src", "id div 2 AS dst")
    assert {r.component for r in CC.connected_components(e).collect()} == {0}
    assert len(seen) > 3 and not any("Repartition" in p for p in seen)
