"""The corpus pipeline: four stages over ``documents``, each written as Parquet and reread.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows that its
predecessor kept; all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph.llm.common import cut, table
from txgraph.llm.line_dedup import dedup_lines
from txgraph.llm.packing import pack
from txgraph.llm.quality import fit_quality, score_quality
from txgraph.llm.setsketch import near_duplicates

KEEP_FROM = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored KEEP_FROM or higher by the classifier stay (operator 1)."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = "_" * 8 + "score"
    return score_quality(docs, model, score_col=score).filter(F.col(score) >= KEEP_FROM).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents go, ``n_chars`` follows the text (operator 10)."""
    out = dedup_lines(docs, whole_rows=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id
    (operator 6); documents without an id stay."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences (operator 7)."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifier and the retrieval packing are not expressible in SQL; tests/llm holds the
#: pipeline against a version without Spark.
ORACLE_SQL = None
