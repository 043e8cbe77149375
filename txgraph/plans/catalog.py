"""Registered queries: one Spark plan per operator and the DuckDB text of the same result.

Every query reads the test tables (through ``plans.fixtures``) or data Spark derives
from them, over whole tables. Floats are rounded to 9 decimals on both sides; every
computed column is aliased to the same name on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph import schema as S
from txgraph.functions.hexval import hex_to_long
from txgraph.operators import build as B
from txgraph.operators import clustering as C
from txgraph.operators import community as CM
from txgraph.operators import components as CC
from txgraph.operators import degrees as D
from txgraph.operators import sample as SM
from txgraph.operators import triangles as T
from txgraph.operators import views as V
from txgraph.plans import fixtures as fx
from txgraph.plans import payloads as P
from txgraph.plans.report import graph_report
from txgraph.session import cut, cut_table, drop_scratch, freed_shuffles, scratch_path
from txgraph.sources import blocks as BK
from txgraph.sources import csv as CSV
from txgraph.sources import gexf as GX
from txgraph.sources import store as ST

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
MODULARITY_GROUPS = 16
TOP_K = 3
LPA_STEPS = 5
RANGE_BLOCK, RANGE_BLOCKS = 1000, 30
SNOW_HEIGHT, SNOW_SEEDS, SNOW_FANOUT, SNOW_HOPS = 1000, 5, 5, 3
REPORT_DATE = "2020-05-01"
REF_PAGE = 5


def _r9(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def _dense(spark, d):
    return fx.dense_edges(spark, d)


def _monthly(spark, d):
    return fx.monthly_edges(spark, d)


def _giant(spark, d):
    # read three times (components, their vertex set, the edge selection): materialise once
    e = cut_table(_monthly(spark, d))
    comps = cut_table(CC.connected_components(e))
    gv, ge = CC.top_components(e, comps, 1)
    return cut_table(gv), cut_table(ge)


def _giant_labels(spark, d):
    gv, ge = _giant(spark, d)
    return ge, CM.label_propagation(ge, LPA_STEPS, gv.select("id"))


def _group_labels(spark, d):
    e = _dense(spark, d)
    return e, V.endpoint_ids(e).select("id", (F.col("id") % MODULARITY_GROUPS).alias("label"))


def _address_edges(spark, d):
    return fx.transactions(spark, d).select(
        "hash", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
        "value")


def _csv_roundtrip(spark, d):
    tx = _address_edges(spark, d)
    base = scratch_path(spark, "csv")
    CSV.write_graph_csv(SM.node_table(tx), tx, f"{base}/nodes", f"{base}/edges")
    return CSV.read_vertices(spark, f"{base}/nodes"), CSV.read_edges(spark, f"{base}/edges")


def _by_order(spark, d, lines):
    """The ``lines`` of all transactions, an order's made where the join has dealt its rows."""
    own, rest = fx.keyed_transactions(spark, d)
    return lines(own).unionByName(lines(rest))


def _shifted_blocks(tx, shifts):
    """For each of ``shifts`` the blocks of ``tx`` with that added to height and value."""
    tx = tx.withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    return P.v2_blocks(tx.withColumn("height", F.col("height") + F.col("shift"))
                       .withColumn("value", F.col("value") + F.col("shift")), "shift")


def _blocks(spark, d, *shifts: int):
    """The ingested blocks; with ``shifts`` once for each, all from one reading of the tables, so that the
    copies of a transaction lie in one task."""
    lines = (lambda tx: _shifted_blocks(tx, shifts)) if shifts else P.v2_blocks
    return BK.split_lines(_by_order(spark, d, lines), col="json").drop(S.CORRUPT)


def _stream(spark, d):
    from txgraph.streaming.blocks import read_stream_blocks, stream_blocks

    base = scratch_path(spark, "stream")
    with freed_shuffles(spark):
        _by_order(spark, d, P.v2_blocks).write.text(f"{base}/landing", compression="gzip")
    q = stream_blocks(spark, f"{base}/landing", f"{base}/out", f"{base}/state")
    q.awaitTermination()
    drop_scratch(spark, f"{base}/landing")
    drop_scratch(spark, f"{base}/state")
    return read_stream_blocks(spark, f"{base}/out")


def _hard_lines(spark, d):
    path = scratch_path(spark, "hard")
    with freed_shuffles(spark):
        _by_order(spark, d, P.hard_v2_lines).write.text(path, compression="gzip")
    return path


def _hard_batch(spark, d, null_to="keep"):
    path = _hard_lines(spark, d)
    rows, _, _ = BK.ingest_lines(spark.read.text(path), null_to)
    drop_scratch(spark, path)  # its rows and rejects are written
    return SM.dedup_last_wins(rows)


def _hard_stream(spark, d):
    from txgraph.streaming.blocks import read_stream_blocks, stream_blocks

    base = scratch_path(spark, "stream")
    # few triggers in a run, so that the base is rewritten on the way
    path = _hard_lines(spark, d)
    stream_blocks(spark, path, f"{base}/out", f"{base}/state",
                  max_files_per_trigger=4, compact=2).awaitTermination()
    drop_scratch(spark, path)
    drop_scratch(spark, f"{base}/state")
    return read_stream_blocks(spark, f"{base}/out")


def _hard_corrupt(spark, d):
    _, _, counts = BK.ingest_lines(spark.read.text(_hard_lines(spark, d)))
    return spark.createDataFrame([(counts["rejected"],)], "corrupt bigint")


def _built(spark, d):
    """The dense table as a graph whose given vertices are the senders only: B2 adds the receivers."""
    tx = cut_table(_address_edges(spark, d).select("src", "dst", "value"))
    senders = tx.select(F.col("src").alias("address")).distinct()
    return B.build_graph(senders, tx, on_missing="add")


def _hard_graph(spark, d):
    """The default ingest, receivers missing, as a graph: B12, B1, B2, B3."""
    rows = cut_table(_hard_batch(spark, d).select("src", "dst", "value"))
    return B.build_graph(SM.node_table(rows), rows)


def _hard_modularity(spark, d):
    g = _hard_graph(spark, d)
    labels = g.vertices.select("id", (F.col("id") % MODULARITY_GROUPS).alias("label"))
    return CM.modularity(g.edges, labels, formula="half_intra")


def _hard_raw(spark, d):
    """The ingested rows themselves, addresses as numbers, without the graph build."""
    return _hard_batch(spark, d).select(
        F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "value")


def _rows_roundtrip(spark, d):
    path = scratch_path(spark, "rows")
    CSV.write_rows(_address_edges(spark, d), path, sep="|")
    return spark.read.schema("hash string, src string, dst string, value bigint").option(
        "sep", "|").option("header", True).option("mode", "FAILFAST").csv(path)


def _gexf_tables(spark, d):
    """Vertices and edges of the export; the edges, read three times, are written once."""
    e = cut_table(_monthly(spark, d))
    return V.endpoint_ids(e).withColumn("label", F.col("id").cast("string")), e


def _gexf_document(spark, d):
    """The written document, line by line, with every line's number in it."""
    path = scratch_path(spark, "gexf")
    GX.write_gexf(*_gexf_tables(spark, d), path, date=REPORT_DATE)
    return GX.read_document(spark, path)


def _stored_range(spark, d):
    path = scratch_path(spark, "bands")
    ST.write_tx_table(fx.transactions(spark, d), path)
    rows = ST.read_tx_range(spark, path, RANGE_BLOCK - RANGE_BLOCKS + 1, RANGE_BLOCK)
    return SM.block_range_sample(rows, RANGE_BLOCK, RANGE_BLOCKS)


def _indexed_snowball(spark, d):
    bands, index = scratch_path(spark, "bands"), scratch_path(spark, "incidence")
    ST.write_tx_table(fx.transactions(spark, d), bands)
    tx = spark.read.parquet(bands).drop("band")
    ST.write_incidence(tx, index)
    return SM.snowball_sample(tx, SNOW_HEIGHT, SNOW_SEEDS, SNOW_FANOUT, SNOW_HOPS,
                              incident=lambda a: ST.read_incidence(spark, index, a))


def _dictionary(spark, d):
    """Two loads: the senders, then all ends of the transactions."""
    import uuid

    tx = _address_edges(spark, d)
    ids = ST.IdDictionary(spark, f"ids_{uuid.uuid4().hex}", scratch_path(spark, "ids"))
    ids.load(tx.select("src").distinct(), "src")
    return ids, ids.encode(tx)


def _hex_forms(spark, d):
    tx = fx.transactions(spark, d)
    h = F.hex("value")
    return tx.select(
        "hash",
        hex_to_long(F.lower(h)).alias("v_plain"),
        hex_to_long(F.concat(F.lit(" \t0000000000000000000"), h, F.lit(" "))).alias("v_padded"),
        hex_to_long(F.concat(F.lit("-"), h)).alias("v_neg"),
        hex_to_long(F.concat(h, F.lit("abcdef0123"))).alias("v_long"),
        hex_to_long(F.concat(h, F.lit("xyz"))).alias("v_bad"),
    )


def _report(spark, d):
    return graph_report(_monthly(spark, d)).select(
        "vertices", "edges", _r9("global_clustering").alias("global_clustering"),
        _r9("transitivity").alias("transitivity"),
        _r9("average_clustering").alias("average_clustering"),
        "zero_local_vertices", "nonzero_local_vertices", "components", "greatest_vertices",
        "greatest_edges", "clusters", _r9("modularity").alias("modularity"))


def _local(spark, d):
    lc = C.local_clustering(_dense(spark, d))
    return lc.select("id", "neighbours", "edges_between", _r9("coefficient").alias("coefficient"))


def _one(col: str, df: DataFrame) -> DataFrame:
    return df.select(_r9(col).alias(col))


QUERIES: dict[str, Query] = {
    # fixture and sources
    "tx_table": lambda s, d: fx.transactions(s, d),
    "vertices_distinct": lambda s, d: V.endpoint_ids(_dense(s, d)),
    "graph_counts": lambda s, d: B.graph_counts(V.endpoint_ids(_dense(s, d)), _dense(s, d)),
    "csv_roundtrip_vertices": lambda s, d: _csv_roundtrip(s, d)[0],
    "csv_roundtrip_edges": lambda s, d: _csv_roundtrip(s, d)[1],
    "assign_ids": lambda s, d: B.assign_ids(SM.node_table(_address_edges(s, d))),
    "encode_edges": lambda s, d: B.encode_edges(
        _address_edges(s, d), B.assign_ids(SM.node_table(_address_edges(s, d)))),
    # edge views
    "drop_self_loops": lambda s, d: V.drop_self_loops(_dense(s, d)),
    "merge_parallel": lambda s, d: V.merge_parallel(_dense(s, d)),
    "directed_edges": lambda s, d: V.directed_edges(_dense(s, d)),
    "simple_edges": lambda s, d: V.simple_edges(_dense(s, d)),
    "neighbours": lambda s, d: V.neighbours(_dense(s, d)),
    # degrees
    "degrees_multi": lambda s, d: D.degrees(_dense(s, d), "multi"),
    "degrees_directed": lambda s, d: D.degrees(_dense(s, d), "directed"),
    "degrees_simple": lambda s, d: D.degrees(_dense(s, d), "simple"),
    "degree_filter": lambda s, d: D.degree_filter(_dense(s, d)),
    "degree_filter_edges": lambda s, d: D.degree_filter_graph(_monthly(s, d)),
    "possible_triplets": lambda s, d: D.possible_triplets(_dense(s, d)),
    # triangles and clustering
    "triangles": lambda s, d: T.triangles(_dense(s, d)),
    "triangle_count": lambda s, d: T.triangle_count(_dense(s, d)),
    "triangles_total": lambda s, d: T.triangle_total(_dense(s, d)),
    "local_clustering": _local,
    "local_split": lambda s, d: C.local_split(_dense(s, d)),
    "average_clustering": lambda s, d: _one("average_clustering", C.average_clustering(_dense(s, d))),
    "global_clustering": lambda s, d: _one("global_clustering", C.global_clustering(_dense(s, d))),
    "global_clustering_simple": lambda s, d: _one(
        "global_clustering", C.global_clustering(_dense(s, d), "simple")),
    "transitivity": lambda s, d: _one("transitivity", C.transitivity(_dense(s, d))),
    "transitivity_simple": lambda s, d: _one("transitivity", C.transitivity(_dense(s, d), "simple")),
    # components
    "connected_components": lambda s, d: CC.connected_components(_monthly(s, d)),
    "component_sizes": lambda s, d: CC.component_sizes(CC.connected_components(_monthly(s, d))),
    "top_components_vertices": lambda s, d: CC.top_components(
        _monthly(s, d), CC.connected_components(_monthly(s, d)), TOP_K)[0],
    "top_components_edges": lambda s, d: _giant(s, d)[1],
    # communities
    "label_propagation": lambda s, d: _giant_labels(s, d)[1],
    "cluster_count": lambda s, d: CM.cluster_count(_giant_labels(s, d)[1]),
    "cluster_sizes": lambda s, d: CM.cluster_sizes(_giant_labels(s, d)[1]),
    "cluster_links": lambda s, d: CM.cluster_links(*_giant_labels(s, d)),
    "modularity_half_intra": lambda s, d: _one(
        "modularity", CM.modularity(*_group_labels(s, d), formula="half_intra")),
    "modularity_standard": lambda s, d: _one(
        "modularity", CM.modularity(*_group_labels(s, d), formula="standard")),
    "lpa_modularity_half_intra": lambda s, d: _one(
        "modularity", CM.modularity(*_giant_labels(s, d), formula="half_intra")),
    "lpa_modularity_standard": lambda s, d: _one(
        "modularity", CM.modularity(*_giant_labels(s, d), formula="standard")),
    "graph_report": _report,
    # payload ingest, samples, exports
    "blocks_ingest": lambda s, d: _blocks(s, d),
    "hex_to_long": _hex_forms,
    "dedup_last_wins": lambda s, d: SM.dedup_last_wins(_blocks(s, d, 0, 1)),
    "block_range_sample": lambda s, d: SM.block_range_sample(
        fx.transactions(s, d), RANGE_BLOCK, RANGE_BLOCKS),
    "block_range_nodes": lambda s, d: SM.node_table(SM.block_range_sample(
        fx.transactions(s, d), RANGE_BLOCK, RANGE_BLOCKS)),
    "v1_block_txids": lambda s, d: BK.ingest_block_txids(
        BK.parse_json(P.v1_blocks(fx.transactions(s, d)), S.BLOCK)),
    "v1_tx_edges": lambda s, d: BK.ingest_tx_edges(
        BK.parse_json(P.v1_transactions(fx.transactions(s, d)), S.TRANSACTION)),
    "v1_address_refs": lambda s, d: BK.ingest_address_refs(
        BK.parse_json(P.v1_addresses(fx.transactions(s, d)), S.ADDRESS), REF_PAGE).select(
        "address", "pos", "tx_hash", "tx_input_n", "tx_output_n", "value"),
    "v1_address_refs_all": lambda s, d: BK.ingest_address_refs(
        BK.parse_json(P.v1_addresses(fx.transactions(s, d)), S.ADDRESS)).select(
        "address", "pos", "tx_hash", "tx_input_n", "tx_output_n", "value"),
    "hard_ingest": _hard_batch,
    "hard_ingest_drop_row": lambda s, d: _hard_batch(s, d, "drop_row"),
    "hard_ingest_drop_block": lambda s, d: _hard_batch(s, d, "drop_block"),
    "hard_ingest_corrupt": _hard_corrupt,
    "hard_stream": _hard_stream,
    "block_range_stored": _stored_range,
    "snowball_indexed": _indexed_snowball,
    "dictionary_vertices": lambda s, d: _dictionary(s, d)[0].table().select(F.col("vid").alias("id"), "address"),
    "dictionary_edges": lambda s, d: _dictionary(s, d)[1],
    "hard_graph_edges": lambda s, d: _hard_graph(s, d).edges,
    "hard_degrees_multi": lambda s, d: D.degrees(_hard_raw(s, d), "multi"),
    "hard_modularity": lambda s, d: _one("modularity", _hard_modularity(s, d)),
    "hard_gexf_edges": lambda s, d: GX.edge_lines(_hard_raw(s, d)).select("line"),
    "build_graph_vertices": lambda s, d: _built(s, d).vertices,
    "build_graph_edges": lambda s, d: _built(s, d).edges,
    "write_rows": _rows_roundtrip,
    "gexf_document": _gexf_document,
    "snowball_sample": lambda s, d: SM.snowball_sample(
        fx.transactions(s, d), SNOW_HEIGHT, SNOW_SEEDS, SNOW_FANOUT, SNOW_HOPS),
    "gexf_lines": lambda s, d: GX.gexf_lines(*_gexf_tables(s, d), date=REPORT_DATE).select(F.col("section").cast("bigint").alias("section"), "line"),
    "stream_blocks": _stream,
}


# --- oracle SQL (DuckDB) ----------------------------------------------------------

_CTE = {
    "tx": fx.TX_SQL,
    "stx": fx.MONTHLY_TX_SQL,
    "e": "SELECT src, dst, value FROM tx",
    "se": "SELECT src, dst, value FROM stx",
}


def _graph_ctes(e: str, p: str = "") -> dict[str, str]:
    """Edge-view CTEs over edge table ``e``, names prefixed with ``p``."""
    return {
        f"{p}dd": f"SELECT DISTINCT src, dst FROM {e} WHERE src <> dst",
        f"{p}u": f"SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {e} WHERE src <> dst",
        f"{p}nb": f"SELECT a AS id, b AS nb FROM {p}u UNION ALL SELECT b, a FROM {p}u",
        f"{p}v": f"SELECT src AS id FROM {e} UNION SELECT dst FROM {e}",
        f"{p}tri": (f"SELECT x.a AS a, x.b AS b, y.b AS c FROM {p}u x JOIN {p}u y ON x.a = y.a AND x.b < y.b "
                    f"JOIN {p}u z ON z.a = x.b AND z.b = y.b"),
        f"{p}tpv": (f"SELECT id, count(*) AS t FROM (SELECT a AS id FROM {p}tri UNION ALL "
                    f"SELECT b FROM {p}tri UNION ALL SELECT c FROM {p}tri) GROUP BY id"),
        f"{p}sdeg": f"SELECT id, count(*) AS k FROM {p}nb GROUP BY id",
        f"{p}ddeg": (f"SELECT id, count(*) AS d FROM (SELECT src AS id FROM {p}dd UNION ALL "
                     f"SELECT dst FROM {p}dd) GROUP BY id"),
        f"{p}lc": (f"SELECT s.id, s.k AS neighbours, coalesce(t.t, 0) AS edges_between, "
                   f"CAST(2 * coalesce(t.t, 0) AS DOUBLE) / CAST(s.k * (s.k - 1) AS DOUBLE) AS coefficient "
                   f"FROM {p}sdeg s LEFT JOIN {p}tpv t ON s.id = t.id WHERE s.k >= 2"),
    }


_CTE.update(_graph_ctes("e"))
_CTE.update(_graph_ctes("se", "s_"))
_CTE.update({
    "reach": ("SELECT id, id AS r FROM s_v UNION "
              "SELECT n.nb, reach.r FROM reach JOIN s_nb n ON reach.id = n.id"),
    "cc": "SELECT id, min(r) AS component FROM reach GROUP BY id",
    "sizes": "SELECT component, count(*) AS size FROM cc GROUP BY component",
    "topc": f"SELECT component FROM sizes ORDER BY size DESC, component LIMIT {TOP_K}",
    "top1": "SELECT component FROM sizes ORDER BY size DESC, component LIMIT 1",
    "gv": "SELECT id FROM cc WHERE component IN (SELECT component FROM top1)",
    "ge": ("SELECT se.src, se.dst, se.value FROM se JOIN cc ON se.src = cc.id "
           "WHERE cc.component IN (SELECT component FROM top1)"),
    "w": ("SELECT f, t, count(*) AS w FROM (SELECT src AS f, dst AS t FROM ge UNION ALL "
          "SELECT dst, src FROM ge) GROUP BY f, t"),
    "l0": "SELECT id, id AS label FROM gv",
    "grp": f"SELECT id, id % {MODULARITY_GROUPS} AS label FROM v",
    "block_tx": ("SELECT height, CAST(row_number() OVER (PARTITION BY split_part(hash, '-', 1) "
                 "ORDER BY hash) - 1 AS BIGINT) AS pos, hash, CAST(src AS VARCHAR) AS src, "
                 "CAST(dst AS VARCHAR) AS dst, value FROM tx"),
    # E2 over the hard lines: the lower block wins, in it the later of the repeated positions
    "hard": ("SELECT height, CAST(pos + count(*) OVER (PARTITION BY split_part(hash, '-', 1)) AS BIGINT) "
             "AS pos, hash, src, CASE WHEN value % 2 <> 0 THEN dst END AS dst, value + 2 AS value FROM block_tx"),
    "hn": ("SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, value FROM hard"),
    "hids": ("SELECT address, row_number() OVER (ORDER BY address) - 1 AS vid FROM "
             "(SELECT src AS address FROM hard UNION SELECT dst FROM hard WHERE dst IS NOT NULL)"),
    "he": ("SELECT s.vid AS src, d.vid AS dst, hard.value FROM hard JOIN hids s ON hard.src = s.address "
           "JOIN hids d ON hard.dst = d.address"),
    "hgrp": f"SELECT vid AS id, vid % {MODULARITY_GROUPS} AS label FROM hids",
    "bids": ("SELECT address, row_number() OVER (ORDER BY late, address) - 1 AS vid FROM ("
             "SELECT CAST(src AS VARCHAR) AS address, 0 AS late FROM tx GROUP BY src UNION ALL "
             "SELECT CAST(dst AS VARCHAR), 1 FROM tx WHERE dst NOT IN (SELECT src FROM tx) GROUP BY dst)"),
    "rng": (f"SELECT hash, src, dst, value, height FROM tx WHERE height BETWEEN "
            f"{RANGE_BLOCK - RANGE_BLOCKS + 1} AND {RANGE_BLOCK}"),
})
for _k in range(1, LPA_STEPS + 2):
    _CTE[f"l{_k}"] = (
        f"SELECT p.id, coalesce(b.label, p.label) AS label FROM l{_k - 1} p LEFT JOIN ("
        f"SELECT t AS id, label FROM (SELECT t, label, row_number() OVER (PARTITION BY t "
        f"ORDER BY n DESC, label) AS rn FROM (SELECT w.t, l.label, sum(w.w) AS n FROM w "
        f"JOIN l{_k - 1} l ON w.f = l.id GROUP BY w.t, l.label)) WHERE rn = 1) b ON p.id = b.id")
_LPA = f"l{LPA_STEPS + 1}"

# snowball: hops unrolled; every hop re-expands all addresses known so far.
_CTE.update({
    "inc": "SELECT src AS address, hash, height FROM tx UNION SELECT dst, hash, height FROM tx",
    "rtop": (f"SELECT address, hash FROM (SELECT address, hash, row_number() OVER (PARTITION BY "
             f"address ORDER BY height DESC, hash) AS rk FROM inc) WHERE rk <= {SNOW_FANOUT}"),
    "t0": (f"SELECT hash FROM tx WHERE height = (SELECT min(height) FROM tx WHERE height >= "
           f"{SNOW_HEIGHT}) ORDER BY hash LIMIT {SNOW_SEEDS}"),
})
for _k in range(1, SNOW_HOPS + 1):
    _CTE[f"a{_k}"] = (f"SELECT src AS address FROM tx WHERE hash IN (SELECT hash FROM t{_k - 1}) "
                      f"UNION SELECT dst FROM tx WHERE hash IN (SELECT hash FROM t{_k - 1})")
    _CTE[f"t{_k}"] = (f"SELECT hash FROM t{_k - 1} UNION SELECT r.hash FROM rtop r "
                      f"JOIN a{_k} a ON r.address = a.address")


def _deps(sql: str) -> list[str]:
    """CTE names used by ``sql``, transitively, in definition order."""
    import re

    names = list(_CTE)
    used: set[str] = set()

    def visit(text: str) -> None:
        for n in names:
            if n not in used and re.search(rf"\b{re.escape(n)}\b", text):
                used.add(n)
                visit(_CTE[n])

    visit(sql)
    return [n for n in names if n in used]


def _with(body: str) -> str:
    deps = _deps(body)
    if not deps:
        return body
    rec = "RECURSIVE " if "reach" in deps else ""
    return "WITH " + rec + ",\n".join(f"{n} AS ({_CTE[n]})" for n in deps) + "\n" + body


def _mod_sql(e: str, lab: str, formula: str) -> str:
    le = (f"SELECT a.label AS ls, b.label AS ld FROM {e} JOIN {lab} a ON {e}.src = a.id "
          f"JOIN {lab} b ON {e}.dst = b.id")
    cw = (f"SELECT label, sum(intra) AS intra, count(*) AS total FROM (SELECT ls AS label, "
          f"CASE WHEN ls = ld THEN 1 ELSE 0 END AS intra FROM ({le}) UNION ALL "
          f"SELECT ld, 0 FROM ({le}) WHERE ls <> ld) GROUP BY label")
    if formula == "half_intra":
        lin, sq = "2.0", "CAST(total AS DOUBLE) * CAST(total AS DOUBLE)"
    else:
        lin, sq = "1.0", "CAST(intra + total AS DOUBLE) * CAST(intra + total AS DOUBLE)"
    return (f"SELECT round(CAST(sum(intra) AS DOUBLE) / ({lin} * (SELECT count(*) FROM {e})) - "
            f"sum({sq}) / (4.0 * CAST((SELECT count(*) FROM {e}) AS DOUBLE) * "
            f"(SELECT count(*) FROM {e})), 9) AS modularity FROM ({cw})")


def _glob_sql(p: str, deg: str) -> str:
    return (f"SELECT round(avg(CAST(coalesce(t.t, 0) AS DOUBLE) / CAST(d.{deg[1]} * (d.{deg[1]} - 1) / 2 AS DOUBLE)), 9) "
            f"AS global_clustering FROM {p}{deg[0]} d LEFT JOIN {p}tpv t ON d.id = t.id WHERE d.{deg[1]} >= 2")


def _trans_sql(p: str, deg: str) -> str:
    return (f"SELECT round(CAST(3 * (SELECT count(*) FROM {p}tri) AS DOUBLE) / "
            f"CAST(sum(CAST({deg[1]} * ({deg[1]} - 1) / 2 AS BIGINT)) AS DOUBLE), 9) AS transitivity "
            f"FROM {p}{deg[0]} WHERE {deg[1]} >= 2")


_GEXF_FIXED = [
    (0, '<?xml version="1.0" encoding="UTF-8"?>'),
    (0, f'<gexf xmlns="{GX.GEXF_NS}" version="{GX.GEXF_VERSION}">'),
    (0, f'<meta lastmodifieddate="{REPORT_DATE}">'),
    (0, "<creator>txgraph</creator>"),
    (0, "<description>transaction graph</description>"),
    (0, "</meta>"),
    (0, '<graph mode="static" defaultedgetype="directed">'),
    (0, "<nodes>"), (2, "</nodes>"), (2, "<edges>"),
    (4, "</edges>"), (4, "</graph>"), (4, "</gexf>"),
]


def _gexf_sql() -> str:
    fixed = " UNION ALL ".join(
        "SELECT CAST({} AS BIGINT) AS section, '{}' AS line".format(s, line.replace("'", "''"))
        for s, line in _GEXF_FIXED)
    return (f"{fixed} UNION ALL SELECT CAST(1 AS BIGINT), '<node id=\"' || CAST(id AS VARCHAR) || "
            f"'\" label=\"' || CAST(id AS VARCHAR) || '\" />' FROM s_v UNION ALL "
            f"SELECT CAST(3 AS BIGINT), '<edge source=\"' || CAST(src AS VARCHAR) || '\" target=\"' || "
            f"CAST(dst AS VARCHAR) || '\" label=\"' || CAST(value AS VARCHAR) || '\" />' FROM se")


def _gexf_document_sql() -> str:
    fixed = " UNION ALL ".join(
        "SELECT {} AS s, CAST({} AS BIGINT) AS k1, CAST(NULL AS BIGINT) AS k2, "
        "CAST(NULL AS VARCHAR) AS k3, '{}' AS line".format(s, i, line.replace("'", "''"))
        for i, (s, line) in enumerate(_GEXF_FIXED))
    return ("SELECT row_number() OVER (ORDER BY s, k1, k2, k3) - 1 AS n, line FROM ("
            f"{fixed} UNION ALL SELECT 1, id, NULL, NULL, '<node id=\"' || CAST(id AS VARCHAR) || "
            "'\" label=\"' || CAST(id AS VARCHAR) || '\" />' FROM s_v UNION ALL "
            "SELECT 3, src, dst, CAST(value AS VARCHAR), '<edge source=\"' || CAST(src AS VARCHAR) || "
            "'\" target=\"' || CAST(dst AS VARCHAR) || '\" label=\"' || CAST(value AS VARCHAR) || "
            "'\" />' FROM se)")


_REPORT_SQL = (
    "SELECT (SELECT count(*) FROM s_v) AS vertices, (SELECT count(*) FROM se) AS edges, "
    f"({_glob_sql('s_', ('ddeg', 'd'))}) AS global_clustering, "
    f"({_trans_sql('s_', ('ddeg', 'd'))}) AS transitivity, "
    "(SELECT round(avg(coefficient), 9) FROM s_lc) AS average_clustering, "
    "(SELECT count(*) FILTER (WHERE coefficient = 0) FROM s_lc) AS zero_local_vertices, "
    "(SELECT count(*) FILTER (WHERE coefficient <> 0) FROM s_lc) AS nonzero_local_vertices, "
    "(SELECT count(DISTINCT component) FROM cc) AS components, "
    "(SELECT count(*) FROM gv) AS greatest_vertices, (SELECT count(*) FROM ge) AS greatest_edges, "
    f"(SELECT count(DISTINCT label) FROM {_LPA}) AS clusters, "
    f"({_mod_sql('ge', _LPA, 'half_intra')}) AS modularity"
)

_ORACLE_BODIES: dict[str, str] = {
    "tx_table": "SELECT * FROM tx",
    "vertices_distinct": "SELECT id FROM v",
    "graph_counts": "SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges",
    "csv_roundtrip_vertices": ("SELECT CAST(src AS VARCHAR) AS address FROM tx UNION "
                               "SELECT CAST(dst AS VARCHAR) FROM tx"),
    "csv_roundtrip_edges": ("SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, value FROM "
                            "(SELECT DISTINCT hash, src, dst, value FROM tx)"),
    "assign_ids": ("SELECT address, row_number() OVER (ORDER BY address) - 1 AS vid FROM "
                   "(SELECT CAST(id AS VARCHAR) AS address FROM v)"),
    "encode_edges": ("SELECT s.vid AS src, d.vid AS dst, tx.value FROM tx "
                     "JOIN (SELECT address, row_number() OVER (ORDER BY address) - 1 AS vid FROM "
                     "(SELECT CAST(id AS VARCHAR) AS address FROM v)) s ON CAST(tx.src AS VARCHAR) = s.address "
                     "JOIN (SELECT address, row_number() OVER (ORDER BY address) - 1 AS vid FROM "
                     "(SELECT CAST(id AS VARCHAR) AS address FROM v)) d ON CAST(tx.dst AS VARCHAR) = d.address"),
    "drop_self_loops": "SELECT src, dst, value FROM e WHERE src <> dst",
    "merge_parallel": "SELECT src, dst, min(value) AS value FROM e GROUP BY src, dst",
    "directed_edges": "SELECT src, dst FROM dd",
    "simple_edges": "SELECT a, b FROM u",
    "neighbours": "SELECT id, nb FROM nb",
    "degrees_multi": ("SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, "
                      "count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL "
                      "SELECT dst, 1, 0 FROM e) GROUP BY id"),
    "degrees_directed": ("SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, "
                         "count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM dd UNION ALL "
                         "SELECT dst, 1, 0 FROM dd) GROUP BY id"),
    "degrees_simple": "SELECT id, k AS degree FROM sdeg",
    "degree_filter": "SELECT id, d AS degree FROM ddeg WHERE d >= 2",
    "degree_filter_edges": ("SELECT src, dst, value FROM se WHERE src IN (SELECT id FROM s_ddeg WHERE d >= 2) "
                            "AND dst IN (SELECT id FROM s_ddeg WHERE d >= 2)"),
    "possible_triplets": ("SELECT id, d AS degree, CAST(d * (d - 1) / 2 AS BIGINT) AS pairs FROM ddeg "
                          "WHERE d >= 2"),
    "triangles": "SELECT a, b, c FROM tri",
    "triangle_count": "SELECT v.id, coalesce(t.t, 0) AS triangles FROM v LEFT JOIN tpv t ON v.id = t.id",
    "triangles_total": "SELECT count(*) AS triangles FROM tri",
    "local_clustering": "SELECT id, neighbours, edges_between, round(coefficient, 9) AS coefficient FROM lc",
    "local_split": ("SELECT count(*) FILTER (WHERE coefficient = 0) AS zero_vertices, "
                    "count(*) FILTER (WHERE coefficient <> 0) AS nonzero_vertices FROM lc"),
    "average_clustering": "SELECT round(avg(coefficient), 9) AS average_clustering FROM lc",
    "global_clustering": _glob_sql("", ("ddeg", "d")),
    "global_clustering_simple": _glob_sql("", ("sdeg", "k")),
    "transitivity": _trans_sql("", ("ddeg", "d")),
    "transitivity_simple": _trans_sql("", ("sdeg", "k")),
    "connected_components": "SELECT id, component FROM cc",
    "component_sizes": "SELECT component, size FROM sizes",
    "top_components_vertices": "SELECT id, component FROM cc WHERE component IN (SELECT component FROM topc)",
    "top_components_edges": "SELECT src, dst, value FROM ge",
    "label_propagation": f"SELECT id, label FROM {_LPA}",
    "cluster_count": f"SELECT count(DISTINCT label) AS clusters FROM {_LPA}",
    "cluster_sizes": f"SELECT label, count(*) AS size FROM {_LPA} GROUP BY label",
    "cluster_links": (f"SELECT label, other, CAST(count(*) AS DOUBLE) AS weight FROM ("
                      f"SELECT a.label AS label, b.label AS other FROM ge JOIN {_LPA} a ON ge.src = a.id "
                      f"JOIN {_LPA} b ON ge.dst = b.id UNION ALL "
                      f"SELECT b.label, a.label FROM ge JOIN {_LPA} a ON ge.src = a.id "
                      f"JOIN {_LPA} b ON ge.dst = b.id WHERE a.label <> b.label) GROUP BY label, other"),
    "modularity_half_intra": _mod_sql("e", "grp", "half_intra"),
    "modularity_standard": _mod_sql("e", "grp", "standard"),
    "lpa_modularity_half_intra": _mod_sql("ge", _LPA, "half_intra"),
    "lpa_modularity_standard": _mod_sql("ge", _LPA, "standard"),
    "graph_report": _REPORT_SQL,
    "blocks_ingest": "SELECT * FROM block_tx",
    "hex_to_long": ("SELECT hash, value AS v_plain, value AS v_padded, -value AS v_neg, "
                    "coalesce(TRY_CAST('0x' || hex(value) || 'abcdef0123' AS BIGINT), 9223372036854775807) "
                    "AS v_long, CAST(9223372036854775807 AS BIGINT) AS v_bad FROM tx"),
    "dedup_last_wins": "SELECT * FROM block_tx",
    "block_range_sample": "SELECT * FROM rng",
    "block_range_nodes": "SELECT src AS address FROM rng UNION SELECT dst FROM rng",
    "v1_block_txids": ("SELECT 'blk-' || split_part(hash, '-', 1) AS block_hash, height, "
                       "CAST(row_number() OVER (PARTITION BY split_part(hash, '-', 1) ORDER BY hash) - 1 AS BIGINT) "
                       "AS pos, hash AS txid FROM tx"),
    "v1_tx_edges": ("SELECT hash, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, value FROM tx"),
    "v1_address_refs": (
        "SELECT address, CAST(rk - 1 AS BIGINT) AS pos, tx_hash, tx_input_n, tx_output_n, value FROM ("
        "SELECT *, row_number() OVER (PARTITION BY address, block ORDER BY tx_hash, tx_input_n) AS rk FROM ("
        "SELECT CAST(src AS VARCHAR) AS address, split_part(hash, '-', 1) AS block, hash AS tx_hash, "
        "CAST(0 AS INTEGER) AS tx_input_n, CAST(-1 AS INTEGER) AS tx_output_n, value FROM tx UNION ALL "
        "SELECT CAST(dst AS VARCHAR), split_part(hash, '-', 1), hash, CAST(-1 AS INTEGER), "
        "CAST(0 AS INTEGER), value FROM tx)) WHERE rk <= 5"),
    "v1_address_refs_all": (
        "SELECT address, CAST(rk - 1 AS BIGINT) AS pos, tx_hash, tx_input_n, tx_output_n, value FROM ("
        "SELECT *, row_number() OVER (PARTITION BY address, block ORDER BY tx_hash, tx_input_n) AS rk FROM ("
        "SELECT CAST(src AS VARCHAR) AS address, split_part(hash, '-', 1) AS block, hash AS tx_hash, "
        "CAST(0 AS INTEGER) AS tx_input_n, CAST(-1 AS INTEGER) AS tx_output_n, value FROM tx UNION ALL "
        "SELECT CAST(dst AS VARCHAR), split_part(hash, '-', 1), hash, CAST(-1 AS INTEGER), "
        "CAST(0 AS INTEGER), value FROM tx))"),
    "hard_ingest": "SELECT * FROM hard",
    "hard_ingest_drop_row": "SELECT * FROM hard WHERE dst IS NOT NULL",
    "hard_ingest_drop_block": ("SELECT * FROM hard WHERE split_part(hash, '-', 1) NOT IN "
                               "(SELECT split_part(hash, '-', 1) FROM hard WHERE dst IS NULL)"),
    "hard_ingest_corrupt": "SELECT count(DISTINCT split_part(hash, '-', 1)) AS corrupt FROM tx",
    "hard_stream": "SELECT * FROM hard",
    "hard_graph_edges": "SELECT src, dst, value FROM he",
    "hard_degrees_multi": ("SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, "
                           "count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM hn WHERE dst IS NOT NULL "
                           "UNION ALL SELECT dst, 1, 0 FROM hn WHERE dst IS NOT NULL) GROUP BY id"),
    "hard_modularity": _mod_sql("he", "hgrp", "half_intra"),
    "hard_gexf_edges": ("SELECT '<edge source=\"' || CAST(src AS VARCHAR) || '\" target=\"' || CAST(dst AS VARCHAR) "
                        "|| '\" label=\"' || CAST(value AS VARCHAR) || '\" />' AS line FROM hn WHERE dst IS NOT NULL"),
    "build_graph_vertices": "SELECT vid AS id, address FROM bids",
    "build_graph_edges": ("SELECT s.vid AS src, d.vid AS dst, tx.value FROM tx "
                          "JOIN bids s ON CAST(tx.src AS VARCHAR) = s.address "
                          "JOIN bids d ON CAST(tx.dst AS VARCHAR) = d.address"),
    "write_rows": "SELECT hash, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, value FROM tx",
    "gexf_document": _gexf_document_sql(),
    "snowball_sample": (
        "SELECT tx.hash, tx.src, tx.dst, tx.value, tx.height, h.hop FROM tx JOIN ("
        "SELECT hash, CAST(min(hop) AS INTEGER) AS hop FROM ("
        + " UNION ALL ".join(f"SELECT hash, {k} AS hop FROM t{k}" for k in range(SNOW_HOPS + 1))
        + ") GROUP BY hash) h ON tx.hash = h.hash"),
    "gexf_lines": _gexf_sql(),
    "stream_blocks": "SELECT * FROM block_tx",
}

# the stored layouts give what the plain operators give
_ORACLE_BODIES["block_range_stored"] = _ORACLE_BODIES["block_range_sample"]
_ORACLE_BODIES["snowball_indexed"] = _ORACLE_BODIES["snowball_sample"]
_ORACLE_BODIES["dictionary_vertices"] = _ORACLE_BODIES["build_graph_vertices"]
_ORACLE_BODIES["dictionary_edges"] = _ORACLE_BODIES["build_graph_edges"]

ORACLE_SQL: dict[str, str] = {k: _with(v) for k, v in _ORACLE_BODIES.items()}
