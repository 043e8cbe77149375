"""Operator 12 against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty

from txgraph.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_counts(rows):
    n = Counter()
    for d, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(UP)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary():
    """Words with chains of forms, ties, repeated letters, letters above ASCII and long runs."""
    rnd = random.Random(2)
    ws = {}
    for base in ("banana", "aaaaaa", "élèves", "mississippi", "straße", "×÷×÷×÷", "abcabcabc", "k" * 63, "k" * 80, "q" * 300):
        ws[base] = 900
        x = base
        for c in (170, 30, 5):
            k = rnd.randrange(len(x))
            x = rnd.choice([x[:k] + x[k + 1:], x[:k] + rnd.choice("abé") + x[k:], x[:k] + "z" + x[k + 1:]])
            ws[x] = max(ws.get(x, 0), c)
        for _ in range(12):
            k = rnd.randrange(len(base))
            ws.setdefault(base[:k] + rnd.choice("abcé") + base[k + rnd.randrange(2):], rnd.choice([4, 5, 6, 30]))
    return ws


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    bag = [w if rnd.random() < 0.9 else w.upper() if w.isascii() else w for w, c in vocabulary().items() for _ in range(c)]
    rnd.shuffle(bag)
    seps = [" ", "\n", "1", "Ā", "漢", "-", "ª", "🎉"]
    rows = [(rnd.choice([None, k, -k, (1 << 53) + k]), "".join(w + rnd.choice(seps) for w in bag[k::40])) for k in range(40)]
    rows += [(r.doc_id, r.text) for r in documents(spark).collect()]
    n = brute_counts(rows)
    got = S.variants(documents(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(n)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(w[1] is not None and w[2] != w[1] for w in want) >= 3      # chains
    # rows, words and blocks of any cut
    monkeypatch.setattr(S, "BLOCK", 2000)
    words = spark.createDataFrame(sorted(n.items()), "word string, n bigint")
    some = {r.word: (r.n_near, r.best) for r in S.near_words(words).collect()}
    assert {w: k for w, (k, _) in some.items()} == {w[0]: w[4] for w in want if w[4]}


def test_tiles_over_several_batches():
    """A tile that goes on over batches is compared whole, once."""
    import pyarrow as pa

    ws = [f"{a}{b}cdef" for a in "abcdefghij" for b in "abcdefghij"]
    batch = pa.RecordBatch.from_arrays([pa.array(ws), pa.array(range(5, 105), pa.int64())], names=["word", "n"])
    t = pa.Table.from_batches(S._tiles([batch])).sort_by([("longer", "ascending"), ("tile", "ascending")])
    want = {w: sum(one_edit(w, v) for v in ws) for w in ws}
    old, S.GROUP = S.GROUP, 50
    try:
        got = Counter()
        for b in S._compared(t.to_batches(max_chunksize=7)):
            for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[w] += k
    finally:
        S.GROUP = old
    assert got == want


@pytest.mark.parametrize("length", [6, 7, 64, 65, 400])
def test_segments_cover(length):
    cuts = S.segments(length)
    assert cuts[0] == 0 and cuts[-1] == length and all(np.diff(cuts) > 0) and len(cuts) <= S.LONG // 2 + 2


def test_empty(spark):
    assert S.variants(empty(spark)).count() == 0
    assert S.variants(documents(spark, [(1, None), (2, "short wordsonce")])).count() == 0
