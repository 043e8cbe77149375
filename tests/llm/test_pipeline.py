"""The pipeline against a version of its stages without Spark."""

import os

import pytest

pytest.importorskip("public_tokenizers")
from test_lines_and_urls import brute_lines  # noqa: E402
from test_near import brute_near  # noqa: E402
from test_tokens import check_packing, lib  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_stages(spark):
    import hashlib

    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert all(d in ids for d, q in labels.items() if q == 1)
    bad = [d for d, q in labels.items() if q == 0]      # a dozen rows: few to learn from
    assert sum(d in ids for d in bad) <= 0.3 * len(bad)

    kept = P.cut(kept)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lines = P.cut(P.lines(spark, kept, SF))
    assert lines.columns == docs.columns
    got = {r.doc_id: r for r in lines.collect()}
    assert {(d, hashlib.sha256((got[d].text or "").encode()).hexdigest()) for d in got} == \
        {(d, h) for d, _, _, h in brute_lines(rows)}
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)

    near = P.cut(P.near(spark, lines, SF))
    assert {r.doc_id for r in near.collect()} == \
        {d for d, _, _, keep in brute_near([(d, r.text) for d, r in got.items()]) if keep}

    tok = lib("byte_bpe_50k.json")
    check_packing(P.packing(spark, near, SF).collect(), {
        r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in near.collect()})


def test_rows_that_are_odd(spark):
    import corpus_pipeline as P
    from cases import documents

    df = documents(spark).selectExpr("*", "'en' AS lang", "cast(0 AS bigint) AS n_chars")
    lines = P.lines(spark, df, SF)
    assert lines.columns == df.columns and lines.count() == df.count()
    near = P.near(spark, P.cut(lines), SF)
    assert near.columns == df.columns and near.filter("doc_id IS NULL").count() == 2
