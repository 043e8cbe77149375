"""Operator 1, quality classifier: histogram gradient-boosted trees over text statistics.

``fit_quality`` draws at most ``max_rows`` labelled rows (the bound is this parameter; the
rows are those with the smallest hash of the id, so the draw does not depend on the file
order), computes their statistics in Spark and grows the trees from binned statistics with
numpy. The trees are flattened into complete-tree arrays; ``score_quality`` walks all trees
of all rows of a batch level by level with array indexing, in one pass over the whole texts
without a shuffle.

Only the text is an input of a score. Rows whose crc32 of the id is divisible by
``folds`` are held out: they are never trained on.

Defined results: a null text is scored as an empty one; every row gives a row, repeated
rows included; a null id is not held out and never trained on; null labels are left out;
without usable labels every score is 0.5, with labels of one class it is near that class.
An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm.common import ship

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "blank", "newline", "exclaim", "bar", "signs",
    "stops", "other_punct", "high", "control", "byte_entropy", "log_words", "word_len",
    "longest_word", "distinct_words", "top_word", "same_next", "caps_words", "title_words",
    "sign_end", "word_entropy", "log_lines", "line_len", "distinct_lines", "top_line",
)


def text_stats(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = c[c > 0] / n
    up, low, dig = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    blank, nl, excl, bar = c[32], c[10], c[33], c[124]
    signs = c[35] + c[36] + c[37] + c[38] + c[42]
    stops = c[44] + c[46] + c[59] + c[58] + c[63]
    high = c[128:].sum()
    ctrl = c[:32].sum() - nl
    other = n - (up + low + dig + blank + nl + excl + bar + signs + stops + high + ctrl)
    words = text.split()
    m = len(words)
    out = [np.log1p(n), up / n, low / n, dig / n, blank / n, nl / n, excl / n, bar / n,
           signs / n, stops / n, other / n, high / n, ctrl / n, float(-(p * np.log2(p)).sum())]
    if m:
        by = Counter(words)
        k = np.fromiter(by.values(), np.float64, len(by)) / m
        caps = title = ends = letters = longest = 0
        for w, x in by.items():
            size = len(w)
            letters += size * x
            if size > longest:
                longest = size
            if size > 1 and w.isupper():
                caps += x
            elif w[0].isupper():
                title += x
            if w[-1] in "#$%&*!|":
                ends += x
        out += [np.log1p(m), letters / m, np.log1p(longest), len(by) / m, k.max(),
                sum(map(eq, words, words[1:])) / m, caps / m, title / m, ends / m,
                float(-(k * np.log2(k)).sum())]
    else:
        out += [0.0] * 10
    lines = text.split("\n")
    by = Counter(lines)
    out += [np.log1p(len(lines)), np.log1p(n / len(lines)), len(by) / len(lines),
            max(by.values()) / len(lines)]
    return out


@dataclass
class Trees:
    """Complete trees of one depth in flat arrays: node i of a tree has the children 2i+1
    and 2i+2; ``leaf`` holds the values of the last level."""

    depth: int
    base: float
    feature: np.ndarray     # [trees, 2^depth - 1]
    threshold: np.ndarray   # [trees, 2^depth - 1]; right if the statistic is above
    leaf: np.ndarray        # [trees, 2^depth]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        z = np.full(len(x), self.base)
        if len(x) and len(self.leaf):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(self.depth):
                right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            z = z + self.leaf[trees, node - (2 ** self.depth - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
         bins: int = 64, l2: float = 1.0, min_hess: float = 1.0) -> Trees:
    """Boost ``trees`` trees on the logistic loss from histograms of binned statistics."""
    inner = 2 ** depth - 1
    if not len(y):
        return Trees(depth, 0.0, np.zeros((0, inner), int), np.zeros((0, inner)),
                     np.zeros((0, inner + 1)))
    n, f = x.shape
    rate1 = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate1 / (1 - rate1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    z = np.full(n, base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)                     # within its level
        for d in range(depth):
            wide = 2 ** d
            best = np.zeros(wide)
            at_f, at_b = np.zeros(wide, np.int64), np.full(wide, bins, np.int64)
            for j in range(f):
                key = node * bins + binned[:, j]
                hg = np.bincount(key, g, wide * bins).reshape(wide, bins).cumsum(1)
                hh = np.bincount(key, h, wide * bins).reshape(wide, bins).cumsum(1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = (hg ** 2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2)
                        - tg ** 2 / (th + l2))
                gain[(hh < min_hess) | (th - hh < min_hess)] = 0
                gain[:, len(cuts[j]):] = 0               # no cut above the last one
                b = gain.argmax(1)
                v = gain[np.arange(wide), b]
                won = v > best + 1e-12
                best[won], at_f[won], at_b[won] = v[won], j, b[won]
            first = wide - 1
            for k in range(wide):
                feature[t, first + k] = at_f[k]
                if at_b[k] < bins:
                    threshold[t, first + k] = cuts[at_f[k]][at_b[k]]
            right = x[np.arange(n), feature[t, first + node]] > threshold[t, first + node]
            node = 2 * node + right
        sg = np.bincount(node, g, inner + 1)
        sh = np.bincount(node, h, inner + 1)
        leaf[t] = -rate * sg / (sh + l2)
        z = z + leaf[t][node]
    return Trees(depth, base, feature, threshold, leaf)


def held_out(id_col: str, folds: int = 5):
    """True where crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0,
                      F.lit(False))


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality", folds: int = 5,
                max_rows: int = 20_000, **grow_args) -> Trees:
    """Trees fitted on at most ``max_rows`` labelled rows that are not held out."""
    ship(df.sparkSession)
    drawn = (labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out("key", folds))
             .orderBy(F.xxhash64("key"), "key", "y").limit(max_rows))
    rows = (df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(drawn), "key"))

    def stats(batches):
        for b in batches:
            key, y = b.column("key"), b.column("y")
            x = pa.array([text_stats(t) for t in b.column("text").to_pylist()],
                         pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([key, y, x], names=["key", "y", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    got = (rows.select("key", "y", "text").mapInArrow(stats, f"key {kind}, y int, x array<double>")
           .orderBy(F.xxhash64("key"), "key", "y", "x").limit(max_rows).toArrow())
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return grow(x, got.column("y").to_numpy().astype(float), **grow_args)


def score_quality(df: DataFrame, model: Trees, text_col: str = "text",
                  score_col: str = "score") -> DataFrame:
    """``df`` with the score of every row's whole text; a column of that name is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    ship(df.sparkSession)
    src = df.drop(score_col)
    at = src.columns.index(text_col)

    def score(batches):
        for b in batches:
            x = np.array([text_stats(t) for t in b.column(at).to_pylist()],
                         np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(model.score(x), pa.float64())],
                names=[*b.schema.names, score_col])

    return src.mapInArrow(score, StructType([*src.schema.fields,
                                             StructField(score_col, DoubleType())]))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            keep_from: float = 0.3, **fit_args) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = fit_quality(df, labels, id_col, text_col, **fit_args)
    scored = score_quality(df.select(id_col, F.col(text_col).cast("string").alias(text_col)),
                           model, text_col)
    return scored.select(
        id_col, held_out(id_col).alias("held_out"), "score",
        (F.col("score") >= keep_from).cast("int").alias("predicted"))
