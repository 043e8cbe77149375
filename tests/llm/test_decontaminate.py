"""Operator 11 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from cases import LONG, documents, empty

from txgraph.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def toks(t):
    return WORD.findall((t or "").translate(UP))


def brute(rows, items, window=10):
    wins = []
    for name, t in items:
        ws = toks(t)
        n = min(window, len(ws))
        wins += [(name, tuple(ws[k:k + n])) for k in range(len(ws) - n + 1)] if n else []
    out = []
    for d, t in rows:
        ws, hit, names = toks(t), set(), set()
        for name, w in wins:
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k:k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    names |= {str(name)} if name is not None else set()
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d, len(ws), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shape", ["random", "periodic", "copies", "ones"])
def test_suffix_array_sorts_all_runs(shape):
    rnd = np.random.default_rng(3)
    seq = {"random": rnd.integers(0, 5, 3000), "periodic": np.tile([1, 2, 1, 0, 1], 500),
           "copies": np.tile(np.r_[rnd.integers(1, 9, 700), 0], 4), "ones": np.r_[np.ones(2000, int), 0]}[shape]
    seq = np.r_[seq, 0].astype(np.int64)
    sa = D.suffix_array(seq)
    ends = np.flatnonzero(seq == 0)
    runs = [tuple(seq[p:ends[np.searchsorted(ends, p)]]) for p in sa]
    assert sorted(sa) == list(np.flatnonzero(seq)) and runs == sorted(runs)


def items():
    rnd = random.Random(5)
    ws = [f"w{k}" for k in range(40)]
    return [(k, " ".join(rnd.choices(ws, k=rnd.randrange(1, 25)))) for k in range(12)] + [
        (100, "Lorem ipsum dolor"), (7, "two words"), (7, "İstanbul ΣΑΣ naïve"), (None, "no id here a"),
        (101, None), (102, ""), (103, "..."), (104, "loves " * 12), (9, "two words")]


def rows_with_passages():
    rnd = random.Random(6)
    its = items()
    ws = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(60):
        t = rnd.choices(ws, k=rnd.randrange(30))
        for _ in range(rnd.randrange(3)):
            own = toks(rnd.choice(its)[1])
            a = rnd.randrange(len(own) + 1)
            t[rnd.randrange(len(t) + 1):0] = [x.upper() for x in own[a // 2:a + 11]]
        rows.append((k, "\n".join(t)))
    return rows + [(None, "x TWO-words"), (3, "loves " * 40), ((1 << 53) + 1, "two words"), (200, None)]


def bench(spark, rows=None):
    return spark.createDataFrame(items() if rows is None else rows, "item_id bigint, text string")


@pytest.mark.parametrize("block_words", [1 << 20, 30])
def test_against_brute_force(spark, monkeypatch, block_words):
    docs = documents(spark)
    rows = rows_with_passages() + [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(D, "SHARD_BYTES", 2000)
    got = D.decontaminate(documents(spark, rows), bench(spark), block_words=block_words)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, items())


def test_empty_tables_and_clean_documents(spark):
    assert D.decontaminate(empty(spark), bench(spark)).count() == 0
    docs = documents(spark)
    none = D.decontaminate(docs, bench(spark, [])).collect()
    assert len(none) == docs.count() and not any(r.contaminated for r in none)
    kept = D.clean_documents(docs, bench(spark))
    assert kept.schema == docs.schema
    want = [r for r in brute([(r.doc_id, r.text) for r in docs.collect()], items()) if not r[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in want), key=repr)


def test_longest_matches(spark):
    text = " ".join(f"v{k}" for k in range(50))
    docs = documents(spark, [(1, "x " + " ".join(f"v{k}" for k in range(10, 35)) + " y"),
                             (2, " ".join(f"v{k}" for k in range(5, 20))), (3, LONG)])
    got = sorted(map(tuple, D.longest_matches(docs, bench(spark, [(5, text), (6, "z " + text)])).collect()))
    assert got == [("5", 5, 15, 2, 0), ("5", 10, 25, 1, 1), ("6", 6, 15, 2, 0), ("6", 11, 25, 1, 1)]
