"""Operator 7, packing by lexical retrieval: sharded BM25 indexes fill windows.

1. one pass encodes every whole text (ids, then the end id) into a written table of packed
   16-bit or 32-bit ids, and counts in how many documents each id occurs. Terms are token
   ids, so the table of document frequencies has the size of the vocabulary, however large
   the corpus, and covers all of it;
2. documents are dealt to shards of about ``shard_tokens`` tokens by content: those with the same
   weightiest BM25 term go together, terms that lie next to each other fill a shard up, so what
   a seed would retrieve from the whole corpus lies mostly in its own shard, however many there
   are. Documents of a term that is heavier than a shard are dealt over as many as it needs
   by a hash of id and text, so that copies or a hot source never make one task's group;
3. each shard builds a BM25 inverted index over its documents. The lowest unused document
   seeds a window; its weightiest terms retrieve the best-scoring unused neighbours of the
   shard, which fill the window in that order. The last one is cut where the window ends
   and its rest seeds the next window; if no neighbour is left, the next unused document
   follows. So all windows of a shard but the last are full;
4. the last window of a shard is cut into sequences whose lengths are powers of two, which
   need no padding.

Every task holds one shard. Sequence ids are ``shard * 2^32 + number in the shard``.

Defined results: a null text is an empty one and has the end id alone; every row is packed,
repeated rows and null ids included; an empty table gives no rows. Only id and text are
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm import vocab
from txgraph.llm.common import cut, ship, slices

QUERY_TERMS = 12
K1, B = 1.2, 0.75

_loaded: dict[tuple, object] = {}
_widths: dict[str, str] = {}


def _encoder(path: str, wide: str):
    """A function from a text to its packed ids. A rank-based library takes whole texts and
    remembers nothing; other files are encoded segment by segment, with a table of segments."""
    if (path, wide) not in _loaded:
        one = vocab.rank_encoder(path)
        if one is None:
            enc, cut_ = vocab.Encoder(path), vocab.segmenter(path)
            get = vocab.SegmentTable(lambda s: np.array(enc.encode([s])[0], wide).tobytes()).__getitem__
            _loaded[path, wide] = lambda text: b"".join(map(get, cut_(text)))
        else:
            _loaded[path, wide] = lambda text: one(text).astype(wide).tobytes()
    return _loaded[path, wide]


def encode_packed(texts: list[str], path: str, end_id: int, wide: str = "<u4") -> list[bytes]:
    """ids of each text and the end id, as little-endian unsigned integers."""
    one, tail = _encoder(path, wide), np.array([end_id], wide).tobytes()
    return [one(t) + tail for t in texts]


def _width(path: str, end_id: int) -> str:
    """16 bits where all ids of the file fit, else 32."""
    size = vocab.Encoder(path).size()
    return "<u2" if max(size - 1, end_id) < 65536 else "<u4"


def encode_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str,
                     end_id: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc, h, n, ids): packed ids of every row; h hashes id and text."""
    ship(df.sparkSession)

    def rows(batches):
        path = vocab.resolve(vocabulary)
        if path not in _widths:
            _widths[path] = _width(path, end_id)
        wide = _widths[path]
        size, mark = int(wide[-1]), wide[-1].encode()
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            for i, j in slices(batch_bytes, list(map(len, texts))):
                ids = encode_packed(texts[i:j], path, end_id, wide)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j],
                     pa.array([len(x) // size for x in ids], pa.int64()),
                     pa.array([mark + x for x in ids], pa.binary())],
                    names=["doc", "h", "n", "ids"])

    src = df.select(F.col(id_col).cast("bigint").alias("doc"),
                    F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("h"),
                    F.col(text_col).cast("string"))
    return src.mapInArrow(rows, "doc bigint, h bigint, n bigint, ids binary")


def _wide(ids: bytes) -> np.ndarray:
    """Packed ids, led by the digit of their width in bytes, as 32-bit integers."""
    return np.frombuffer(ids, "<u" + chr(ids[0]), offset=1).astype("<u4")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """(documents per id, documents, tokens) over all rows; one number per vocabulary entry
    reaches the driver."""

    def rows(batches):
        df, n_docs, n_tok = np.zeros(0, np.int64), 0, 0
        for b in batches:
            for x in b.column(0).to_pylist():
                ids = _wide(x)
                seen = np.unique(ids)
                if len(seen) and seen[-1] >= len(df):
                    df = np.concatenate((df, np.zeros(int(seen[-1]) + 1 - len(df), np.int64)))
                df[seen] += 1
                n_docs += 1
                n_tok += len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((at, [-1, -2])).astype(np.int64)),
             pa.array(np.concatenate((df[at], [n_docs, n_tok])).astype(np.int64))],
            names=["term", "n"])

    got = (docs.select("ids").mapInArrow(rows, "term bigint, n bigint")
           .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    by = dict(zip(got.column("term").to_pylist(), got.column("n").to_pylist()))
    n_docs, n_tok = by.pop(-1, 0), by.pop(-2, 0)
    out = np.zeros(max(by, default=-1) + 1, np.int64)
    if by:
        out[list(by)] = list(by.values())
    return out, n_docs, n_tok


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p((n_docs - df + 0.5) / (df + 0.5))


def _weights(tf: np.ndarray, idf: np.ndarray, size, mean_len: float) -> np.ndarray:
    tf = tf.astype(np.float64)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_len))


def weightiest(ids: np.ndarray, idf: np.ndarray, mean_len: float) -> int:
    """The term of a document with the largest weight, the smallest of equal ones."""
    t, c = np.unique(ids, return_counts=True)
    return int(t[np.argmax(_weights(c, idf[t], len(ids), mean_len))])


def shard_plan(totals: dict[int, int], terms: int, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of every term, given the tokens of the documents it is the
    weightiest term of."""
    first, count = np.zeros(terms, np.int64), np.ones(terms, np.int64)
    shard, fill = 0, 0
    for t in sorted(totals):
        n = totals[t]
        if fill and fill + n > shard_tokens:
            shard, fill = shard + 1, 0
        first[t], count[t] = shard, max(1, -(-n // shard_tokens))
        if n >= shard_tokens:
            shard, fill = shard + int(count[t]), 0
        else:
            fill += n
    return first, count


class ShardIndex:
    """BM25 inverted index over the documents of a shard."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_docs: int, mean_len: float):
        self.idf = _idf(df, n_docs)
        terms, owner, tf = [], [], []
        for i, d in enumerate(docs):
            t, c = np.unique(d, return_counts=True)
            terms.append(t)
            owner.append(np.full(len(t), i, np.int32))
            tf.append(c)
        self.start_of = np.cumsum([0, *map(len, terms)])
        term, who = np.concatenate(terms), np.concatenate(owner)
        size = np.array([len(d) for d in docs], np.float64)
        w = _weights(np.concatenate(tf), self.idf[term], size[who], mean_len)
        self.doc_terms, self.doc_weights = term, w
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_w = who[order], w[order].astype(np.float32)
        self.firsts = np.searchsorted(term[order], np.arange(len(df) + 1))
        self.score = np.zeros(len(docs), np.float32)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a weighty term with the seed, best first."""
        a, b = self.start_of[seed], self.start_of[seed + 1]
        t, w = self.doc_terms[a:b], self.doc_weights[a:b]
        if len(t) > QUERY_TERMS:
            t = t[np.argpartition(-w, QUERY_TERMS)[:QUERY_TERMS]]
        self.score[:] = 0
        for x in t.tolist():
            i, j = self.firsts[x], self.firsts[x + 1]
            self.score[self.post_doc[i:j]] += self.post_w[i:j]      # a document occurs once
        hits = np.flatnonzero((self.score > 0) & unused)
        return hits[np.argsort(-self.score[hits], kind="stable")]


def pack_shard(sizes: np.ndarray, index: ShardIndex, window: int) -> list[tuple]:
    """(document, start, length, sequence, offset) pieces of one shard's documents."""
    n = len(sizes)
    unused = np.ones(n, bool)
    pieces, seq, fill, nxt = [], 0, 0, 0
    queue: list[int] = []      # neighbours that wait, best first, reversed

    def place(d, start, length):
        nonlocal seq, fill
        pieces.append((d, start, length, seq, fill))
        fill += length
        if fill == window:
            seq, fill = seq + 1, 0

    while True:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            d = queue.pop()
        else:
            while nxt < n and not unused[nxt]:
                nxt += 1
            if nxt == n:
                break
            d = nxt
        unused[d] = False
        at, size = 0, int(sizes[d])
        seeds = fill == 0                   # the document opens a window
        while at < size:
            take = min(size - at, window - fill)
            seeds = seeds or take < size - at
            place(d, at, take)
            at += take
        if seeds or not queue:              # it owns the window that is open now
            queue = index.neighbours(d, unused)[:window].tolist()[::-1] if fill else []
    if fill:
        # cut the open window into lengths that are powers of two
        last = [p for p in pieces if p[3] == seq]
        pieces = pieces[:len(pieces) - len(last)]
        cuts, at = [], 0
        for bit in reversed(range(fill.bit_length())):
            if fill >> bit & 1:
                cuts.append((at, at + (1 << bit)))
                at += 1 << bit
        for d, start, length, _, offset in last:
            for k, (lo, hi) in enumerate(cuts):
                a, b = max(lo, offset), min(hi, offset + length)
                if a < b:
                    pieces.append((d, start + a - offset, b - a, seq + k, a - lo))
    return pieces


def _filled(col: pa.ChunkedArray) -> np.ndarray:
    """The integers of a column, missing ones as the smallest long; no float on the way."""
    return col.fill_null(-(1 << 63)).to_numpy()


def pack(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id",
         text_col: str = "text", window: int = 2048, end_id: int = 1,
         shard_tokens: int = 2_000_000, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece; with
    ``with_ids`` also the piece's ids as an array."""
    docs = cut(encode_documents(df, id_col, text_col, vocabulary, end_id), "packed-ids")
    freq, n_docs, n_tok = document_frequencies(docs)
    mean = n_tok / max(1, n_docs)
    context = df.sparkSession.sparkContext
    bc = context.broadcast(freq)

    def term_tokens(batches):
        idf, total = _idf(bc.value, n_docs), {}
        for b in batches:
            for x in b.column(0).to_pylist():
                ids = _wide(x)
                t = weightiest(ids, idf, mean)
                total[t] = total.get(t, 0) + len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         names=["term", "n"])

    # one number per vocabulary entry, as the document frequencies
    totals = docs.select("ids").mapInArrow(term_tokens, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()
    plan = context.broadcast(shard_plan(dict(zip(totals.column(0).to_pylist(), totals.column(1).to_pylist())),
                                        len(freq), shard_tokens))

    def dealt(batches):
        idf, (first, count) = _idf(bc.value, n_docs), plan.value
        for b in batches:
            t = np.array([weightiest(_wide(x), idf, mean) for x in b.column("ids").to_pylist()], np.int64)
            shard = first[t] + b.column("h").to_numpy() % count[t]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*b.schema.names, "shard"])

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        # any fixed order will do; missing ids first
        t = t.take(pa.array(np.lexsort([_filled(t[c]) for c in ("n", "doc", "h")])))
        ids = [_wide(x) for x in t["ids"].to_pylist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        pieces = pack_shard(sizes, ShardIndex(ids, bc.value, n_docs, mean), window)
        d = np.array([p[0] for p in pieces])
        base = int(t["shard"][0].as_py()) << 32
        out = {
            id_col: t["doc"].take(pa.array(d)),
            "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
            "ids_crc32": [zlib.crc32(ids[p[0]][p[1]:p[1] + p[2]].tobytes()) for p in pieces],
            "doc_tokens": sizes[d], "sequence_id": [base + p[3] for p in pieces],
            "offset": [p[4] for p in pieces]}
        if with_ids:
            out["ids"] = pa.array([ids[p[0]][p[1]:p[1] + p[2]].astype(np.int64) for p in pieces],
                                  pa.list_(pa.int64()))
        return pa.table(out)

    kind = (f"`{id_col}` bigint, start bigint, length bigint, ids_crc32 bigint, "
            "doc_tokens bigint, sequence_id bigint, offset bigint")
    by_shard = docs.mapInArrow(dealt, "doc bigint, h bigint, n bigint, ids binary, shard bigint")
    return by_shard.groupBy("shard").applyInArrow(one, kind + (", ids array<bigint>" if with_ids else ""))
