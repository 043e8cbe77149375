"""Registered queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from txgraph.llm.bpe_trie import bpe_encode
from txgraph.llm.common import table
import corpus_pipeline
from txgraph.llm import decontaminate, line_dedup, topk, url_filter
from txgraph.llm.licenses import license_scan
from txgraph.llm.nn_descent import vector_near_duplicates
from txgraph.llm.packing import pack
from txgraph.llm.quality import quality
from txgraph.llm.setsketch import near_duplicates
from txgraph.llm.spelling import variants
from txgraph.llm.token_counts import token_counts
from txgraph.llm.whitening import whiten


def op1_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_encode(spark, sf_dir):
    return bpe_encode(table(spark, sf_dir, "documents"), digests=True)


def op3_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op4_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op8_vector_near_duplicates(spark, sf_dir):
    return vector_near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), digests=True)


def op11_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))


def op13_whiten(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe_encode": op2_bpe_encode,
    "op3_url_filter": op3_url_filter,
    "op4_topk": op4_topk,
    "op5_token_counts": op5_token_counts,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_packing": op7_packing,
    "op8_vector_near_duplicates": op8_vector_near_duplicates,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_decontaminate": op11_decontaminate,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whiten": op13_whiten,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk": topk.ORACLE,
    "op3_url_filter": url_filter.oracle(),
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_decontaminate": decontaminate.ORACLE,
}
