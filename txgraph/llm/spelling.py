"""Operator 12, spelling variants: dense prefix-suffix tiling of a corpus's words.

1. ``word_counts``: words are counted over whole texts, first in each task (up to ``FLUSH`` words
   at a time), then by Spark.
2. ``near_words``: a single edit leaves a prefix of ``c`` and a suffix of ``s`` letters with
   ``c + s >= longer length - 1``. For a longer length ``L`` the places ``0..L`` are cut into
   segments of two letters; a word of ``L`` or ``L - 1`` letters lies, for every segment
   ``[a, b)``, in the tile of words that share its first ``a`` and last ``L - b`` letters. Two words
   one edit apart meet in the tile of the segment that holds the end of their common prefix, and
   only there are they counted. A tile leaves two letters open, so it holds at most
   ``90 * 90 + 90`` words (a-z and 64 letters above ASCII), whatever the corpus; tiles are laid
   side by side, sorted, in Spark's partitions.
3. In a partition the words lie as padded code-point matrices, left- and right-aligned; blocks of
   pairs of tile mates (``BLOCK`` bytes at a time) are compared whole: common prefix plus common
   suffix against the longer length minus one. What leaves a block is each word's number of
   near words and the best of them, never the pairs.
4. ``variants``: forms are followed to their roots by pointer jumping, log-many joins.

Words over ``LONG`` letters have longer segments (``LONG / 2`` of them), so that a word is
written at most ``LONG + 2`` times; their tiles have no bound by the alphabet, but are
compared in blocks of bounded memory like all others.

Defined results: null and empty texts have no words; a null id is written as nothing in the
string whose crc32 decides on a deletion; rows that repeat an id count each; tables without
words give no rows; other columns are ignored. Texts and words of any length are whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm.common import cut, ship

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
DELETE_ONE_IN = 199
FLUSH = 300_000
LONG = 64
BLOCK = 8 << 20
GROUP = 200_000

# Latin-1 letters as the runs have them, A-Z lower-cased; everything else parts words.
_LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased, as Latin-1 bytes (a byte
    a code point; a character above Latin-1 becomes a ``?``, which parts words as it does)."""
    return text.encode("latin-1", "replace").translate(_LETTER).split() if text else []


def word_counts(docs: DataFrame, id_col: str, text_col: str, min_letters: int, min_count: int) -> DataFrame:
    """(word, n): the words of ``min_letters`` letters and ``min_count`` occurrences or more."""
    ship(docs.sparkSession)

    def count(batches):
        counts: dict[bytes, int] = {}
        utf8: dict[bytes, bytes] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([
                pa.array([w.decode("latin-1") for w in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            utf8.clear()
            return out

        crc = zlib.crc32
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own: dict[bytes, int] = {}
                for w in runs(t):
                    if len(w) >= min_letters:
                        own[w] = own.get(w, 0) + 1
                start = crc(f"{d or ''}:".encode("utf-8", "surrogatepass"))
                for w, n in own.items():
                    if w.isascii():
                        h = crc(w, start)
                    else:
                        h = crc(utf8.get(w) or utf8.setdefault(w, w.decode("latin-1").encode()), start)
                    if h % DELETE_ONE_IN == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                        if len(w) < min_letters:
                            continue
                    counts[w] = counts.get(w, 0) + n
                if len(counts) >= FLUSH:
                    yield flush()
        yield flush()

    src = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    parts = src.mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def segments(length: int) -> list[int]:
    """Cuts ``0 = a_0 < a_1 < ... = length`` for a longer length: two letters apart up to LONG."""
    step = max(2, -(-length // (LONG // 2)))
    return [*range(0, length, step), length]


def _tiles(batches):
    """(tile, longer, seg, word, n) of every tile a word lies in. A tile's number is a 64-bit hash
    of length, segment, prefix and suffix; the comparison looks at the letters themselves."""
    import xxhash

    for b in batches:
        tile, longer, seg, at, size = [], [], [], [], 0
        for i, w in enumerate(b.column(0).to_pylist()):
            x = w.encode("latin-1")
            for length in (len(x), len(x) + 1):
                cuts = segments(length)
                for k, (a, e) in enumerate(zip(cuts, cuts[1:])):
                    key = b"%d,%d," % (length, k) + x[:a] + b"," + x[len(x) - (length - e):]
                    tile.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
                    longer.append(length)
                    seg.append(k)
                    at.append(i)
                    size += len(x) + 32
            if size > (8 << 20):
                yield _rows(b, tile, longer, seg, at)
                tile, longer, seg, at, size = [], [], [], [], 0
        yield _rows(b, tile, longer, seg, at)


def _rows(b, tile, longer, seg, at):
    at = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(tile, pa.int64()), pa.array(longer, pa.int32()), pa.array(seg, pa.int32()),
         b.column(0).take(at), b.column(1).take(at)], names=["tile", "longer", "seg", "word", "n"])


def _padded(words: list[bytes], width: int, right: bool) -> np.ndarray:
    """Code-point matrix, a row a word, padded with 0 at its right or left."""
    fill = bytes.rjust if right else bytes.ljust
    return np.frombuffer(b"".join(fill(w, width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the rows, padding not counted."""
    same = (x == y) & (x > 0)
    return np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))


def compare_tiles(tile: np.ndarray, seg: np.ndarray, longer: int, words: list[bytes], n: np.ndarray):
    """Per word of these tiles, all of one longer length and sorted by tile: the number of near
    words found here and the row of the best of them (-1: none)."""
    m = len(words)
    size = np.array([len(w) for w in words], np.int64)
    left, right = _padded(words, longer, False), _padded(words, longer, True)[:, ::-1]
    cuts = np.array(segments(longer), np.int64)
    by = sorted(range(m), key=lambda i: (-int(n[i]), words[i]))
    place = np.empty(m, np.int64)              # in the order of preference: n down, then letters
    place[by] = np.arange(m)
    near, best = np.zeros(m, np.int64), np.full(m, m, np.int64)
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    end = np.repeat(np.r_[first[1:], m], np.diff(np.r_[first, m]))
    mates = end - np.arange(m) - 1             # row i meets the rows i + 1 .. end - 1 of its tile
    upto = np.cumsum(mates)
    block = max(1, BLOCK // (8 * longer))
    for lo in range(0, int(upto[-1]), block):
        k = np.arange(lo, min(lo + block, int(upto[-1])))
        i = np.searchsorted(upto, k, side="right")
        j = i + 1 + k - (upto[i] - mates[i])
        # two shorter ones belong to another length; a hash may bring two segments together
        ok = (np.maximum(size[i], size[j]) == longer) & (seg[i] == seg[j])
        i, j = i[ok], j[ok]
        c = _common(left[i], left[j])
        # met in every tile they share; counted where the common prefix ends
        ok = np.minimum(np.searchsorted(cuts, c, side="right") - 1, len(cuts) - 2) == seg[i]
        i, j, c = i[ok], j[ok], c[ok]
        ok = c + _common(right[i], right[j]) >= longer - 1
        i, j = i[ok], j[ok]
        for x, y in ((i, j), (j, i)):
            np.add.at(near, x, 1)
            np.minimum.at(best, x, place[y])
    return near, np.array([*by, -1], np.int64)[best]


def _compared(batches):
    """Sorted tile rows in, (word, n_near, best_n, best) out. A tile is compared when all of its
    rows are there; complete ones go together up to ``GROUP`` rows."""
    held, rows = [], 0

    def work(t: pa.Table):
        tile, longer = t["tile"].to_numpy(), t["longer"].to_numpy()
        seg, n = t["seg"].to_numpy(), t["n"].to_numpy()
        # rows alone in their tile have no mate
        same = np.r_[False, (tile[1:] == tile[:-1]) & (longer[1:] == longer[:-1])]
        some = np.flatnonzero(same | np.r_[same[1:], False])
        tile, longer, seg, n = tile[some], longer[some], seg[some], n[some]
        words = [w.encode("latin-1") for w in t["word"].take(pa.array(some)).to_pylist()]
        cuts = [*np.flatnonzero(np.r_[True, longer[1:] != longer[:-1]]), len(words)] if len(words) else []
        for a, e in zip(cuts, cuts[1:]):
            near, best = compare_tiles(tile[a:e], seg[a:e], int(longer[a]), words[a:e], n[a:e])
            ok = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays([
                pa.array([words[a + i].decode("latin-1") for i in ok], pa.string()), pa.array(near[ok]),
                pa.array(n[a:e][best[ok]]), pa.array([words[a + i].decode("latin-1") for i in best[ok]], pa.string())],
                names=["word", "n_near", "best_n", "best"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < GROUP:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        tile, longer = t["tile"].to_numpy(), t["longer"].to_numpy()
        last = (tile == tile[-1]) & (longer == longer[-1])      # may go on in the next batch
        keep = len(tile) - int(last.sum())
        yield from work(t.slice(0, keep))
        held = t.slice(keep).to_batches()
        rows = t.num_rows - keep
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near ones: how many are one
    edit away, and the most frequent of them (ties: the first in code-point order)."""
    ship(words.sparkSession)
    tiles = words.select("word", "n").mapInArrow(
        _tiles, "tile bigint, longer int, seg int, word string, n bigint")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tiles.repartition(parts, "longer", "tile").sortWithinPartitions("longer", "tile").mapInArrow(
        _compared, "word string, n_near bigint, best_n bigint, best string")
    # a word has as many rows as tiles with near words at most, a dozen or so
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best"))).alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last by pointer jumping. Each form
    has more occurrences than its word, so no chain returns."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = cut(at.join(nxt, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``min_letters`` letters and
    ``min_count`` occurrences or more; form: the near word of largest n, if that is ``ratio`` times
    the word's own or more."""
    words = cut(word_counts(docs, id_col, text_col, min_letters, min_count), "words")
    has = F.col("best_n") >= ratio * F.col("n")
    named = cut(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "word-forms")
    ends = roots(named.filter(F.col("form").isNotNull()))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
