"""Operator 11, benchmark decontamination: suffix arrays over the training texts.

Spark deals the documents to tasks; each task cuts its rows into shards of about
``SHARD_BYTES`` of text (a longer document is a shard of its own) and builds the shard's
suffix array: all positions of words that the test set knows, sorted by what follows them,
by prefix doubling in which only still equal suffixes are sorted again. Every suffix of every
test item is binary-searched in every shard: the range of suffixes that start with its window
gives all verbatim occurrences and where they are, the neighbours of its place the longest
match. No document leaves its task, so nothing is shuffled.

The test set goes to the tasks in blocks of whole items of at most ``block_words`` words (an
item longer than that is a block of its own); blocks are handled one after another, and what is
broadcast at a time is bounded by that. Documents are never grouped, so a passage shared by a
third of all documents costs each task its own occurrences only.

Defined results. A text is its words ``[0-9a-z]`` and all above ASCII after lower-casing A-Z;
null, empty and wordless texts have none and are clean. An item's windows are its runs of
``window`` words; an item of fewer, but not none, is one window. Items with one id are one item;
items without an id hit words but are not counted or listed. Rows that repeat a document id are
judged each by itself. Empty tables give no rows, or clean ones. Columns of other names are
ignored (``clean_documents`` keeps them, whatever their names); texts of any length are whole.
"""

from __future__ import annotations

import itertools
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txgraph.llm.common import cut, ship, slices

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20
_OWN = "_" * 8 + "test_hits"

_UPPER = string.ascii_uppercase.encode()
_WORD = bytes(b + 32 if b in _UPPER else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8: every byte above ASCII belongs to a word."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


class TestSet:
    """Items of one block: word numbers (from 1), all items in one array, a 0 after each."""

    def __init__(self, items: list[tuple], window: int):
        self.vocab: dict[bytes, int] = {}
        seq, first, item, size = [], [], [], []
        for name, text in items:
            ws = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if ws:
                n = min(window, len(ws))
                at = range(len(seq), len(seq) + len(ws))
                first += at
                size += [n if len(ws) - k >= n else 0 for k in range(len(ws))]   # 0: within the last window
                item += [name] * len(ws)
                seq += ws + [0]
        self.seq = np.array(seq or [0], np.int64)
        self.first = np.array(first, np.int64)
        self.size = np.array(size, np.int64)
        self.item = item
        # suffixes whose windows are equal share one search of it
        starts: dict[tuple, int] = {}
        self.same = np.full(len(first), -1, np.int64)
        for k in np.flatnonzero(self.size):
            key = tuple(seq[first[k]:first[k] + size[k]])
            self.same[k] = starts.setdefault(key, len(starts))
        self.items_of: list[set] = [set() for _ in starts]
        for k in np.flatnonzero(self.size):
            if item[k] is not None:
                self.items_of[self.same[k]].add(str(item[k]))
        self.reps = np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(self.size)[::-1]:
            self.reps[self.same[k]] = k


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of ``seq`` that hold no 0, sorted by the numbers from there to the next 0."""
    where = np.flatnonzero(seq)
    if not len(where):
        return where
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)      # the next ``step`` numbers, 0 from the first 0 on
    alive = np.ones(n, bool)
    for j in range(step):
        nxt = np.zeros(n, np.int64)
        if j < n:
            nxt[:n - j] = seq[j:]
        alive &= nxt > 0
        key = (key << bits) | np.where(alive, nxt, 0)
    order = where[np.argsort(key[where])]
    rank = np.zeros(n, np.int64)     # 1 and up; 0 where a run has ended
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]]
    slot = np.arange(1, len(order) + 1)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    done = np.r_[new[1:], True] & new
    todo = np.flatnonzero(~done)
    reach = step
    ended = np.zeros(n + 1, np.int64)      # numbers 0 before each position
    np.cumsum(seq == 0, out=ended[1:])
    while len(todo):
        sub = order[todo]
        ahead = np.where(sub + reach < n, rank[np.minimum(sub + reach, n - 1)], 0)
        # a run that ended within ``reach`` is followed by nothing
        ahead = np.where(ended[np.minimum(sub + reach, n)] > ended[sub], 0, ahead)
        own = rank[sub]
        by = np.lexsort((ahead, own))
        sub, own, ahead = sub[by], own[by], ahead[by]
        order[todo] = sub
        new = np.r_[True, (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])]
        rank[sub] = np.maximum.accumulate(np.where(new, todo + 1, 0))
        # equal to the end of their runs: nothing left to tell them apart
        alone = (new & np.r_[new[1:], True]) | (ahead == 0)
        todo = todo[~alone]
        reach *= 2
    return order


def _compare(seq, sa, test, first, limit, at):
    """(-1, 0, 1) of the suffixes ``sa[at]`` against the test suffixes, and the common length.

    0: equal over ``limit`` numbers. A run's end sorts first."""
    sign = np.zeros(len(at), np.int8)
    common = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    j = 0
    while len(live):
        live = live[limit[live] > j]
        if not len(live):
            break
        p = sa[at[live]] + j
        a = np.where(p < len(seq), seq[np.minimum(p, len(seq) - 1)], 0)
        b = test[first[live] + j]
        eq = (a == b) & (a > 0)
        sign[live[~eq]] = np.where(a[~eq] < b[~eq], -1, 1)
        common[live[eq]] += 1
        live = live[eq]
        j += 1
    return sign, common


def _bound(seq, sa, test, first, limit, right):
    """Places of the test suffixes among the suffixes, left or right of equal ones."""
    lo = np.zeros(len(first), np.int64)
    hi = np.full(len(first), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        sign, _ = _compare(seq, sa, test, first[open_], limit[open_], mid)
        up = (sign < 0) | ((sign == 0) if right else False)
        lo[open_] = np.where(up, mid + 1, lo[open_])
        hi[open_] = np.where(up, hi[open_], mid)


class Shard:
    """Some texts in a row and the suffix array over them."""

    def __init__(self, texts, tests: TestSet):
        known, self.starts, parts = tests.vocab.get, [0], []
        self.n_words = []
        for t in texts:
            ws = words(t)
            part = np.zeros(len(ws) + 1, np.int64)
            part[:-1] = np.fromiter(map(known, ws, itertools.repeat(0)), np.int64, len(ws))
            parts.append(part)
            self.n_words.append(len(ws))
            self.starts.append(self.starts[-1] + len(part))
        self.seq = np.concatenate(parts) if parts else np.zeros(1, np.int64)
        self.starts = np.array(self.starts, np.int64)
        self.sa = suffix_array(self.seq)
        self.tests = tests

    def windows(self):
        """(position, unique window) of all occurrences of windows of the test set."""
        t = self.tests
        if not len(self.sa) or not len(t.reps):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, limit = t.first[t.reps], t.size[t.reps]
        lo = _bound(self.seq, self.sa, t.seq, first, limit, False)
        hi = _bound(self.seq, self.sa, t.seq, first, limit, True)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return self.sa[at], which

    def longest(self):
        """(length, position) of each test suffix's longest verbatim match in the shard; position
        -1 where there is none. Ties: either of the neighbours of its place."""
        t = self.tests
        best, where = np.zeros(len(t.first), np.int64), np.full(len(t.first), -1, np.int64)
        if len(self.sa) and len(t.first):
            ends = np.flatnonzero(t.seq == 0)
            limit = ends[np.searchsorted(ends, t.first)] - t.first
            place = _bound(self.seq, self.sa, t.seq, t.first, limit, False)
            for at in (place - 1, place):
                ok = np.flatnonzero((at >= 0) & (at < len(self.sa)))
                _, common = _compare(self.seq, self.sa, t.seq, t.first[ok], limit[ok], at[ok])
                more = common > best[ok]
                best[ok[more]], where[ok[more]] = common[more], self.sa[at[ok[more]]]
        return best, where

    def doc_of(self, pos):
        return np.searchsorted(self.starts, pos, side="right") - 1


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """Yield the items in blocks of at most ``block_words`` words, one at a time on the driver."""
    src = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    block, n = [], 0
    for r in src.toLocalIterator():
        k = len(words(r.text))
        if block and n + k > block_words:
            yield TestSet(block, window)
            block, n = [], 0
        block.append((r.item, r.text))
        n += k
    yield TestSet(block, window)


def _digest_rows(b, at_text, n_own, names, sent):
    """One batch with its hits so far: per row a struct (spans, items, n_words)."""
    tests = sent.value
    texts = b.column(at_text)
    old = b.column(n_own).to_pylist() if b.num_columns > n_own else None
    size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out = []
    for i, j in slices(SHARD_BYTES, size):
        shard = Shard(texts.slice(i, j - i).to_pylist(), tests)
        pos, win = shard.windows()
        doc = shard.doc_of(pos)
        order = np.lexsort((pos, doc))
        pos, win, doc = pos[order], win[order], doc[order]
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(j - i):
            was = old[i + k] if old is not None else None
            if cuts[k] == cuts[k + 1] and not (was and was["n_hit"]):
                out.append({"spans": [], "items": [], "n_words": shard.n_words[k], "n_hit": 0})
                continue
            p, w = pos[cuts[k]:cuts[k + 1]], win[cuts[k]:cuts[k + 1]]
            start = p - shard.starts[k]
            end = start + tests.size[tests.reps[w]]
            items = set().union(*(tests.items_of[x] for x in np.unique(w))) if len(w) else set()
            if was and was["n_hit"]:
                more = np.array(was["spans"], np.int64).reshape(-1, 2)
                start, end = np.r_[start, more[:, 0]], np.r_[end, more[:, 1]]
                items.update(was["items"])
            spans = _union(start, end)
            out.append({"spans": spans.ravel().tolist(), "items": sorted(items),
                        "n_words": shard.n_words[k], "n_hit": int((spans[:, 1] - spans[:, 0]).sum())})
    kind = pa.struct([("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
                      ("n_words", pa.int64()), ("n_hit", pa.int64())])
    cols = list(b.columns[:n_own]) + [pa.array(out, kind)]
    return pa.RecordBatch.from_arrays(cols, names=names + [_OWN])


def _union(start, end) -> np.ndarray:
    """Spans ``[start, end)`` merged where they touch, as rows."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.r_[True, start[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]
    return np.stack([start[new], end[last]], axis=1)


def hit_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` and a struct column (spans: from, to, from, to ... in words, merged; items: sorted
    ids of the items with an occurring window; n_words; n_hit). Its name is ``_OWN``."""
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns
    at, n_own = names.index(text_col), len(names)
    own = T.StructType().add("spans", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.StringType()))
    own = own.add("n_words", T.LongType()).add("n_hit", T.LongType())
    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*out.schema.fields, T.StructField(_OWN, own)])
    for k, tests in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_words)):
        if k:
            out = cut(out, "test-hits")     # one block in a task at a time
        sent = spark.sparkContext.broadcast(tests)

        def search(batches, sent=sent):
            for b in batches:
                yield _digest_rows(b, at, n_own, names, sent)

        out = out.mapInArrow(search, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    own = docs.select(F.col(id_col), F.col(text_col))
    hit = hit_documents(own, benchmark, text_col, item_col, item_text_col, window, block_words)
    x = F.col(_OWN)
    return hit.select(
        F.col(id_col), x["n_words"].alias("n_words"), x["n_hit"].alias("n_hit"),
        F.size(x["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(x["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (x["n_hit"] > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **plan) -> DataFrame:
    """The documents without any window of the test set, all their columns."""
    hit = hit_documents(docs, benchmark, text_col, **plan)
    return hit.filter(F.col(_OWN)["n_hit"] == 0).select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", min_words: int = WINDOW,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item, item_start, n_words, id, doc_start): for each item and place in it the longest verbatim
    match over all documents, of ``min_words`` words or more, and one place where it is (ties:
    the smallest id, then place). Starts inside a longer match one word before are left out."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    for tests in _blocks(benchmark, item_col, item_text_col, min_words, block_words):
        sent = spark.sparkContext.broadcast(tests)

        def search(batches, sent=sent):
            t = sent.value
            begins = np.r_[0, np.flatnonzero(t.seq == 0) + 1]
            inside = t.first - begins[np.searchsorted(begins, t.first, side="right") - 1]
            for b in batches:
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
                for i, j in slices(SHARD_BYTES, size):
                    shard = Shard(b.column(1).slice(i, j - i).to_pylist(), t)
                    best, where = shard.longest()
                    k = np.flatnonzero(best >= min_words)
                    doc = shard.doc_of(where[k])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([t.item[x] for x in k], pa.string()), pa.array(inside[k]),
                        pa.array(best[k]), b.column(0).slice(i, j - i).take(pa.array(doc)),
                        pa.array(where[k] - shard.starts[doc])],
                        names=["item", "item_start", "n_words", "id", "doc_start"])

        rows = src.mapInArrow(search, f"item string, item_start bigint, n_words bigint, id {kind}, doc_start bigint")
        found = rows if found is None else found.unionByName(rows)
    # one row per place in an item: bounded by the test set
    best = found.groupBy("item", "item_start").agg(F.min(F.struct(
        (-F.col("n_words")).alias("m"), F.col("id"), F.col("doc_start"))).alias("b")).select(
        "item", "item_start", (-F.col("b.m")).alias("n_words"), F.col("b.id").alias("id"),
        F.col("b.doc_start").alias("doc_start"))
    before = best.select("item", (F.col("item_start") + 1).alias("item_start"), (F.col("n_words") - 1).alias("rest"))
    return best.join(before, ["item", "item_start"], "left").filter(
        F.col("rest").isNull() | (F.col("rest") < F.col("n_words"))).drop("rest")


ORACLE = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
i AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(ws)) AS l,
             array_to_string(list_slice(ws, p, p + least(10, len(ws)) - 1), ' ') AS gram
      FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT r, l, p, array_to_string(list_slice(ws, p, p + l - 1), ' ') AS gram
      FROM (SELECT r, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS p
            FROM w, (SELECT DISTINCT l FROM g) WHERE len(ws) >= l)),
o AS (SELECT d.r, d.l, d.p, g.item_id FROM d JOIN g ON d.l = g.l AND d.gram = g.gram),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + l - 1)) AS q FROM o) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
       coalesce(s.n_items, 0)::BIGINT AS n_items, sha256(coalesce(s.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.r = h.r LEFT JOIN s ON w.r = s.r
"""
