"""Operator 10, line dedup: levelled sorted runs of line hashes.

``LineRuns`` is a store of runs. A run is a table (h1, h2, n_docs, max_doc) bucketed and sorted
by the line's 128-bit hash, so that runs merge-join without a shuffle; a key stands in one run
only. ``add`` sorts the hashes of a batch likewise and merge-anti-joins them with every run: keys
that no run has are added as a run of level 0, with the batch's counts; the others only leave
a sighting (h1, h2, n_docs, max_doc). ``fanout`` runs of one level are compacted into one of the
next. As a document belongs to one batch, the counts of a key's row and its sightings add up and
the newest document is a maximum; keys without a sighting have all they need in their row. All
are written tables in the shared folder: a lost executor costs no more than its tasks.

``dedup_lines`` feeds a corpus through the store in ``batches`` batches and drops every
line whose key is found in ``min_docs`` or more documents, except in the largest document
id that holds it. Hash rows of very frequent keys are joined with a broadcast of those
keys, of which there are at most ``HEAVY_SHARE`` by pigeonhole; all others are shuffled.

Defined results: a line's key is the line without blanks and controls TAB to CR at its
ends, with A-Z lower-cased; keys under ``min_chars`` code points stay. A null or empty text
is one empty line. Rows that repeat a document id are one document for counting and are
each treated. Rows without an id neither count nor lose lines. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph.llm.common import cut, shared_folder, ship

BLANKS = " \t\n\x0b\x0c\r"
HEAVY_SHARE = 10_000
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_RUN = ["h1", "h2", "n_docs", "max_doc"]


def line_key(line: str) -> str:
    k = line.strip(BLANKS)
    return k.lower() if k.isascii() else k.translate(_LOWER)


def key_hash(key: str) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def line_hashes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2): the distinct keys of each row that are long enough."""
    ship(df.sparkSession)

    def rows(batches):
        for b in batches:
            docs, h1, h2 = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = {line_key(x) for x in t.split("\n")} if t else ()
                for k in keys:
                    if len(k) >= min_chars:
                        a, c = key_hash(k)
                        docs.append(d)
                        h1.append(a)
                        h2.append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=["doc", "h1", "h2"])

    src = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return src.filter(F.col(src.columns[0]).isNotNull()).mapInArrow(
        rows, "doc bigint, h1 bigint, h2 bigint")


class LineRuns:
    """Levelled runs of line hashes."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.sightings: list[DataFrame] = []
        self.folder = shared_folder(spark, "line-runs")

    def _write(self, rows: DataFrame, dealt: bool = False) -> str:
        """A sorted table in buckets; rows that come from joins of such tables are dealt so."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.select(*_RUN)
        ((rows if dealt else rows.repartition(self.buckets, "h1", "h2")).write
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def _forget(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE {n}")       # the catalog's entry; the scratch files stay

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (h1, h2, ...) that no run has: a merge-anti-join per run."""
        for r in self.runs():
            keys = keys.join(r.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, hashes: DataFrame) -> None:
        """Add a batch of (doc, h1, h2); no document may be in two batches."""
        own = (hashes.distinct().groupBy("h1", "h2")
               .agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc")))
        run = self._write(own)
        if self.runs():
            batch, run = run, self._write(self.unseen(self.spark.table(run)), dealt=True)
            new = self.spark.table(run).select("h1", "h2")
            self.sightings.append(cut(self.spark.table(batch).join(new, ["h1", "h2"], "left_anti"),
                                      "line-sightings"))
            self._forget([batch])
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                old = self.levels[k]
                name = self._write(self._merged(old), dealt=True)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(name)
                self.levels[k] = []
                self._forget(old)

    def _merged(self, names: list[str]) -> DataFrame:
        """The rows of all these runs, merged in order of their hashes, no shuffle."""
        out = self.spark.table(names[0]).select(*_RUN)
        for name in names[1:]:
            x, y = out.alias("x"), self.spark.table(name).alias("y")
            out = x.join(y, (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")),
                         "full_outer").select(*(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in _RUN))
        return out

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, max_doc) of the keys found in ``min_docs`` documents or more."""
        runs = reduce(DataFrame.unionByName, self.runs())
        if self.sightings:
            more = cut(reduce(DataFrame.unionByName, self.sightings).groupBy("h1", "h2")
                       .agg(F.sum("n_docs").alias("more"), F.max("max_doc").alias("newest")), "line-sighted")
            runs = reduce(DataFrame.unionByName, [r.join(more, ["h1", "h2"], "left") for r in self.runs()])
            runs = runs.select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"),
                               F.greatest("max_doc", "newest").alias("max_doc"))
        return runs.filter(F.col("n_docs") >= min_docs).select(*_RUN)

    def close(self) -> None:
        """Take the runs out of the session's catalog."""
        self._forget([n for level in self.levels for n in level])
        self.levels = []


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 20, min_docs: int = 3, batches: int = 4,
                fanout: int = 2, digests: bool = False, whole_rows: bool = False) -> DataFrame:
    """(id, n_lines, n_dropped, text) of every row; ``digests``: SHA-256 of the kept text
    in place of the text; ``whole_rows``: instead all columns of ``df``, the text replaced."""
    spark = df.sparkSession
    hashes = cut(line_hashes(df, id_col, text_col, min_chars)
                 .withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches))), "line-hashes")
    store = LineRuns(spark, fanout)
    for i in range(batches):
        store.add(hashes.filter(F.col("batch") == i).select("doc", "h1", "h2"))
    dup = cut(store.repeated(min_docs), "line-repeats")
    store.close()

    total = hashes.count()
    heavy_from = max(min_docs, total // HEAVY_SHARE + 1)    # so many keys at most: HEAVY_SHARE
    heavy = F.broadcast(dup.filter(F.col("n_docs") >= heavy_from))
    light = dup.filter(F.col("n_docs") < heavy_from)
    rows = hashes.select("doc", "h1", "h2")
    of_heavy = rows.join(heavy, ["h1", "h2"], "inner")
    of_light = rows.join(heavy, ["h1", "h2"], "left_anti").join(light, ["h1", "h2"])
    drops = (of_heavy.unionByName(of_light).filter(F.col("doc") < F.col("max_doc"))
             .groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("drops")))

    own = df if whole_rows else df.select(F.col(id_col), F.col(text_col))
    own = own.withColumn(text_col, F.col(text_col).cast("string"))
    at = own.columns.index(text_col)
    names = own.columns

    def apply(batches_):
        for b in batches_:
            n_lines, n_drop, kept = [], [], []
            for t, ds in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                lines = (t or "").split("\n")
                keep = lines
                if ds:
                    out = {(x["h1"], x["h2"]) for x in ds}
                    keep = [x for x in lines if len(k := line_key(x)) < min_chars
                            or key_hash(k) not in out]
                n_lines.append(len(lines))
                n_drop.append(len(lines) - len(keep))
                text = t if len(keep) == len(lines) and whole_rows else "\n".join(keep)
                kept.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                            if digests else text)
            if whole_rows:
                cols = list(b.columns[:len(names)])
                cols[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)
            else:
                yield pa.RecordBatch.from_arrays(
                    [b.column(1 - at), pa.array(n_lines, pa.int64()),
                     pa.array(n_drop, pa.int64()), pa.array(kept, pa.string())],
                    names=[id_col, "n_lines", "n_dropped", out_col])

    # the join's own columns get names that no column of the table has
    key, drop = "_" * 8 + "doc", "_" * 8 + "drops"
    drops = drops.select(F.col("doc").alias(key), F.col("drops").alias(drop))
    joined = own.join(drops, F.col(id_col).cast("bigint") == F.col(key), "left").drop(key)
    if whole_rows:
        return joined.mapInArrow(apply, own.schema)
    out_col = "kept_sha256" if digests else text_col
    kind = own.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(
        apply, f"`{id_col}` {kind}, n_lines bigint, n_dropped bigint, `{out_col}` string")


ORACLE = """
WITH l AS (
  SELECT doc_id, i, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
d AS (SELECT k, max(doc_id) AS m FROM l WHERE length(k) >= 20
      GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT l.doc_id, l.i, l.line, d.k IS NOT NULL AND l.doc_id < d.m AS gone
      FROM l LEFT JOIN d ON l.k = d.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
