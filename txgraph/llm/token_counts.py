"""Operator 5, token counts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is cut again into runs of about ``batch_bytes`` of text, so that a run of
very long texts and a run of short ones cost the encoder alike. Texts are split at safe
boundaries (see ``vocab``), the distinct segments of a run go to the library as one batch,
and only their lengths are kept. A bounded memo carries segments over to later runs.

Defined results: a null text counts as empty (0 bytes, 0 tokens); every row gives a row,
repeated rows and null ids included; an empty table gives no rows. Only the id and the
text column are read, so other columns may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm import vocab
from txgraph.llm.common import ship, slices

_counters: dict[str, tuple] = {}


def _counter(path: str):
    if path not in _counters:
        enc = vocab.Encoder(path)
        _counters[path] = (vocab.segmenter(path), vocab.Memo(enc.lengths))
    return _counters[path]


def count_texts(texts: list[str], path: str) -> list[int]:
    """Token counts of these texts."""
    cut, memo = _counter(path)
    segmented = [cut(t) for t in texts]
    get = memo.table(segmented).__getitem__
    return [sum(map(get, s)) for s in segmented]


def token_counts(df: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 2048,
                 batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is a file name of
    the public vocabularies or a path that every worker can open."""
    ship(df.sparkSession)

    def count(batches):
        path = vocab.resolve(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            n = []
            for i, j in slices(batch_bytes, sizes):
                n.extend(count_texts(texts[i:j], path))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    src = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
