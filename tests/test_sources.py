"""Sources and sinks: CSV, JSON payloads (with malformed lines), GEXF, the block stream."""

import json
import os

from pyspark.sql import functions as F

from txgraph import schema as S
from txgraph.operators.build import build_graph
from txgraph.sources import blocks as BK
from txgraph.sources import csv as CSV
from txgraph.sources import gexf as GX


def _tmp(spark, name):
    from txgraph.session import scratch_path

    return scratch_path(spark, name)


def test_csv_roundtrip_and_prefix(spark):
    base = _tmp(spark, "csvtest")
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "address string")
    e = spark.createDataFrame([("h1", "a", "b", 5), ("h2", "a", "b", 5), ("h3", "b", "c", 1)],
                              "hash string, src string, dst string, value bigint")
    assert CSV.write_graph_csv(v, e, f"{base}/nodes", f"{base}/edges")
    # duplicate rows across files collapse; the folder string is a prefix
    CSV.write_graph_csv(v, e, f"{base}/nodes-2", f"{base}/edges-2")
    assert CSV.read_vertices(spark, f"{base}/nodes").count() == 3
    edges = CSV.read_edges(spark, f"{base}/edges")
    assert edges.count() == 3  # h1 and h2 stay parallel edges
    g = build_graph(CSV.read_vertices(spark, f"{base}/nodes"), edges)
    assert sorted(r.address for r in g.vertices.orderBy("id").collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, g.edges.select("src", "dst").collect())) == [(0, 1), (0, 1), (1, 2)]


def test_csv_skips_empty(spark):
    base = _tmp(spark, "csvempty")
    v = spark.createDataFrame([("a",)], "address string")
    e = spark.createDataFrame([], "hash string, src string, dst string, value bigint")
    assert not CSV.write_graph_csv(v, e, f"{base}/n", f"{base}/e")
    assert not os.path.exists(f"{base}/n".replace("file:", ""))


def test_blocks_with_corrupt_lines(spark):
    good = {"result": {"number": "0x10", "transactions": [
        {"hash": "0xaa", "from": "0x01", "to": "0x02", "value": "0xff"},
        {"hash": "0xbb", "from": "0x02", "to": None, "value": "0x"}]}}
    text = spark.createDataFrame([(json.dumps(good),), ("{not json",)], "json string")
    recs = BK.parse_json(text, S.BLOCK_CONTAINER)
    assert BK.corrupt_count(recs).first()[0] == 1
    rows = {r.hash: r for r in BK.ingest_blocks(recs).collect()}
    assert rows["aa"].value == 255 and rows["aa"].height == 16 and rows["aa"].pos == 0
    assert rows["bb"].dst is None and rows["bb"].value == 9223372036854775807


def test_v1_extractors(spark):
    tx = {"hash": "t1", "total": 7, "inputs": [{"sequence": 1, "addresses": ["a", "z"]}],
          "outputs": [{"value": 7, "addresses": ["b"]}]}
    empty = {"hash": "t2", "total": 1, "inputs": [], "outputs": []}
    txs = BK.parse_json(spark.createDataFrame([(json.dumps(tx),), (json.dumps(empty),)], "json string"),
                        S.TRANSACTION)
    got = {r.hash: (r.src, r.dst, r.value) for r in BK.ingest_tx_edges(txs).collect()}
    assert got == {"t1": ("a", "b", 7), "t2": (None, None, 1)}
    refs = [{"tx_hash": f"h{i}", "tx_input_n": 0, "tx_output_n": -1, "value": i} for i in range(8)]
    ads = [json.dumps({"address": "a", "txrefs": refs}), json.dumps({"address": "b"})]
    recs = BK.parse_json(spark.createDataFrame([(a,) for a in ads], "json string"), S.ADDRESS)
    page = BK.ingest_address_refs(recs, 5)
    assert [r.tx_hash for r in page.orderBy("pos").collect()] == ["h0", "h1", "h2", "h3", "h4"]
    assert BK.ingest_address_refs(recs).count() == 8
    blk = {"hash": "b1", "height": 3, "txids": ["x", "y"]}
    ids = BK.ingest_block_txids(BK.parse_json(spark.createDataFrame([(json.dumps(blk),)], "json string"),
                                              S.BLOCK))
    assert [(r.pos, r.txid) for r in ids.orderBy("pos").collect()] == [(0, "x"), (1, "y")]


def test_gexf_document(spark):
    v = spark.createDataFrame([(1, "a&b"), (2, "<c>")], "id bigint, label string")
    e = spark.createDataFrame([(1, 2, 5)], "src bigint, dst bigint, value bigint")
    path = _tmp(spark, "gexf")
    GX.write_gexf(v, e, path, partitions=3, date="2020-01-01")
    local = path.replace("file:", "")
    parts = sorted(p for p in os.listdir(local) if p.startswith("part-"))
    text = "".join(open(os.path.join(local, p)).read() for p in parts)
    assert text.startswith('<?xml version="1.0"')
    assert text.rstrip().endswith("</gexf>")
    assert '<node id="1" label="a&amp;b" />' in text and "&lt;c&gt;" in text
    assert text.index("</nodes>") < text.index('<edge source="1" target="2" label="5" />')


def test_block_stream_dedups(spark):
    from txgraph.streaming.blocks import read_stream_blocks, stream_blocks, stream_rejects

    base = _tmp(spark, "streamtest")
    blk = {"result": {"number": "0x1", "transactions": [
        {"hash": "0xaa", "from": "0x01", "to": "0x02", "value": "0x1"}]}}
    dup = {"result": {"number": "0x2", "transactions": [
        {"hash": "0xaa", "from": "0x01", "to": "0x02", "value": "0x1"},
        {"hash": "0xbb", "from": "0x02", "to": "0x03", "value": "0x2"}]}}
    local = base.replace("file:", "")
    os.makedirs(f"{local}/landing")
    for i, b in enumerate([blk, dup]):
        with open(f"{local}/landing/{i}.json", "w") as fh:
            fh.write(json.dumps(b) + "\n")
    with open(f"{local}/landing/2.json", "w") as fh:
        fh.write('{"result": {"num\n')
    q = stream_blocks(spark, f"{base}/landing", f"{base}/out", f"{base}/state")
    q.awaitTermination()
    out = read_stream_blocks(spark, f"{base}/out")
    assert sorted((r.hash, r.height) for r in out.collect()) == [("aa", 1), ("bb", 2)]
    assert [r[0] for r in stream_rejects(spark, f"{base}/out").collect()] == ['{"result": {"num']
    # a lower block that lands later wins, as in the batch rule
    with open(f"{local}/landing/3.json", "w") as fh:
        fh.write(json.dumps({"result": {"number": "0x0", "transactions": [
            {"hash": "0xaa", "from": "0x01", "to": "0x02", "value": "0x7"}]}}) + "\n")
    stream_blocks(spark, f"{base}/landing", f"{base}/out", f"{base}/state").awaitTermination()
    rows = {r.hash: (r.height, r.value) for r in read_stream_blocks(spark, f"{base}/out").collect()}
    assert rows["aa"] == (0, 7)


def _land(local, name, number, txs, extra=""):
    rows = [{"hash": h, "from": "0x01", "to": "0x02", "value": hex(v)} for h, v in txs]
    with open(f"{local}/landing/{name}.json", "w") as fh:
        fh.write(json.dumps({"result": {"number": hex(number), "transactions": rows}}) + "\n" + extra)


def test_block_stream_over_many_triggers(spark):
    """One file a trigger, restarts, blocks in any order, compaction: always the batch rule."""
    import random

    from txgraph.operators.sample import dedup_last_wins
    from txgraph.streaming.blocks import read_stream_blocks, stream_blocks, stream_rejects

    base = _tmp(spark, "streammany")
    local = base.replace("file:", "")
    os.makedirs(f"{local}/landing")
    rnd = random.Random(1)
    for part in range(3):
        for k in range(4):
            n = part * 4 + k
            txs = [(f"0x{rnd.randrange(30):02x}", rnd.randrange(100)) for _ in range(12)]
            _land(local, n, rnd.randrange(40), txs, "{cut off\n" if n % 3 == 0 else "")
        stream_blocks(spark, f"{base}/landing", f"{base}/out", f"{base}/state", max_files_per_trigger=1,
                      compact=3).awaitTermination()
        want, bad, counts = BK.ingest_lines(spark.read.text(f"{base}/landing"))
        cols = ["height", "pos", "hash", "src", "dst", "value"]
        got = read_stream_blocks(spark, f"{base}/out")
        assert got.columns == cols
        assert sorted(map(tuple, got.collect())) == sorted(
            map(tuple, dedup_last_wins(want).select(cols).collect()))
        assert sorted(map(tuple, stream_rejects(spark, f"{base}/out").collect())) == [("{cut off", counts["rejected"])]
        assert bad.count() == counts["rejected"] and counts["transactions"] == 12 * 4 * (part + 1)
    assert os.path.isdir(f"{local}/out/base")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan       # reading does not aggregate the history


def test_one_parse_in_batch_and_stream(spark):
    from txgraph.streaming.blocks import block_stream

    base = _tmp(spark, "oneparse")
    spark.createDataFrame([('{"result": {"number": "0x1", "transactions": []}}',), ("{oops",), ('{"id": 3}',),
                           (None,)], "value string").write.text(base)
    for null_to in BK.NULL_TO:
        df = BK.split_lines(spark.read.text(base), null_to)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and "Union" not in plan
        assert sorted(r[S.CORRUPT] for r in df.collect()) == ["", '{"id": 3}', "{oops"]
    plan = block_stream(spark, base)._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json(") == 1 and "Union" not in plan


def test_corrupt_count_and_rejects_of_files(spark):
    base = _tmp(spark, "corrupt")
    good = json.dumps({"result": {"number": "0x1", "transactions": []}})
    spark.createDataFrame([(good,), ("{oops",), ('{"id": 3}',)], "value string").coalesce(1).write.text(base)
    recs = BK.read_json(spark, base, S.BLOCK_CONTAINER)
    assert BK.corrupt_count(recs).first()[0] == 1
    assert BK.rejects(recs).count() == 2


def test_null_to_rules(spark):
    blk = {"result": {"number": "0x1", "transactions": [
        {"hash": "0xaa", "from": "0x01", "to": None, "value": "0x1"},
        {"hash": "0xbb", "from": "0x01", "to": "0x02", "value": "0x1"}]}}
    other = {"result": {"number": "0x2", "transactions": [
        {"hash": "0xcc", "from": "0x01", "to": "0x02", "value": "0x1"}]}}
    recs = BK.parse_json(spark.createDataFrame([(json.dumps(b),) for b in (blk, other)], "json string"),
                         S.BLOCK_CONTAINER)
    got = {k: sorted(r.hash for r in BK.ingest_blocks(recs, k).collect()) for k in BK.NULL_TO}
    assert got == {"keep": ["aa", "bb", "cc"], "drop_row": ["bb", "cc"], "drop_block": ["cc"]}


def test_missing_ends_and_heights(spark):
    from txgraph.operators.sample import dedup_last_wins, node_table
    from txgraph.operators.views import endpoint_ids

    e = spark.createDataFrame([("a", "b"), ("a", None)], "src string, dst string")
    assert sorted(r[0] for r in node_table(e).collect()) == ["a", "b"]
    assert endpoint_ids(e).count() == 2
    rows = spark.createDataFrame(
        [("x", None, 9, 1), ("x", 3, None, 2), ("x", 3, 0, 3), ("x", 3, 4, 4), ("y", None, None, 5)],
        "hash string, height bigint, pos bigint, value bigint")
    assert {r.hash: r.value for r in dedup_last_wins(rows).collect()} == {"x": 4, "y": 5}


def test_encode_missing_endpoints(spark):
    import pytest

    from txgraph.operators.build import encode_edges

    ids = spark.createDataFrame([("a", 0), ("c", 1)], "address string, vid bigint")
    e = spark.createDataFrame([("a", "c", 1), ("a", "b", 2), ("d", "a", 3)],
                              "src string, dst string, value bigint")
    got = {k: sorted(map(tuple, encode_edges(e, ids, k).collect())) for k in ("drop", "add")}
    assert got == {"drop": [(0, 1, 1)], "add": [(0, 1, 1), (0, 2, 2), (3, 0, 3)]}
    with pytest.raises(Exception, match="without a vertex id"):
        encode_edges(e, ids).collect()


def test_write_rows_quotes_separators(spark):
    path = _tmp(spark, "rows")
    rows = spark.createDataFrame([("a|b", 1), ("c", 2)], "x string, y bigint")
    CSV.write_rows(rows, path, sep="|")
    CSV.write_rows(rows, path, sep="|")
    back = spark.read.schema("x string, y bigint").option("sep", "|").option("header", True).csv(path)
    assert sorted(map(tuple, back.collect())) == [("a|b", 1), ("a|b", 1), ("c", 2), ("c", 2)]
