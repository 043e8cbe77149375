"""Operators 2, 5 and 7 against the tokenizers library."""

import hashlib
import struct
import zlib

import pytest

pytest.importorskip("public_tokenizers")
from cases import documents, empty, pairs  # noqa: E402

from txgraph.llm import vocab  # noqa: E402


def lib(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.resolve(name))


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    from txgraph.llm.token_counts import token_counts

    df = documents(spark)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocab.resolve(name))
        n = lambda t: len(sp.encode(t))
    else:
        tok = lib(name)
        n = lambda t: len(tok.encode(t, add_special_tokens=False))
    want = sorted(((d, len(t.encode()), n(t), n(t) > 2048) for d, t in texts(df)), key=repr)
    assert pairs(token_counts(df, name), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts(empty(spark), name).count() == 0


def test_segments_are_safe():
    tok, path = lib("byte_bpe_50k.json"), vocab.resolve("byte_bpe_50k.json")
    cut = vocab.segmenter(path)
    for t in ["a\t  b  c \n\n d\x1c  e !\x1c x", "  lead  <|endoftext|>  x <|endoftext|>", "a   b",
              "x\t", "\n\n", " ", "a  b", "it's  we'll\r\n\r\n  go", "end  "]:
        assert "".join(cut(t)) == t
        assert [i for s in cut(t) for i in tok.encode(s, add_special_tokens=False).ids] == \
            tok.encode(t, add_special_tokens=False).ids


def test_memo_is_bounded():
    memo = vocab.Memo(lambda new: [len(x) for x in new], 10)
    for i in range(100):
        words = [str(j) for j in range(i, i + 4)] + ["y" * 1000]
        got = memo.table([words])
        assert [got[w] for w in words] == [len(w) for w in words]
    assert len(memo.known) + len(memo.older) <= 20 and "y" * 1000 not in memo.known


def test_bpe_encode(spark):
    from txgraph.llm.bpe_trie import bpe_encode

    df, tok = documents(spark), lib("word_bpe_49k.json")
    want = []
    for d, t in texts(df):
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = pairs(bpe_encode(df, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)
    row = bpe_encode(df).filter("doc_id = 1").first()
    assert list(row.ids) == tok.encode(dict(texts(df))[1], add_special_tokens=False).ids
    assert bpe_encode(empty(spark)).count() == 0


def test_trie_on_random_words():
    import random

    from txgraph.llm.bpe_trie import TrieBpe

    path = vocab.resolve("word_bpe_49k.json")
    bpe, tok, rnd = TrieBpe(path), lib("word_bpe_49k.json"), random.Random(3)
    words = {"".join(rnd.choice("aaabcdeinorstzéß'1!.") for _ in range(rnd.randint(1, 14)))
             for _ in range(4000)} | {"a" * n for n in range(1, 40)} | {"ha" * n for n in range(1, 20)}
    words = sorted(words)
    assert bpe.encode_segments(words) == [e.ids for e in tok.encode_batch(words, add_special_tokens=False)]


def check_packing(rows, ids, window=2048):
    at, fill = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.start)):
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.start == at.get(r.doc_id, 0)
        piece = x[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        at[r.doc_id] = r.start + r.length
    assert at == {d: len(x) for d, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(n <= window and n & (n - 1) == 0 for n in fill.values())


def test_packing(spark):
    from txgraph.llm.packing import pack

    df = documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    tok = lib("byte_bpe_50k.json")
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in texts(df)}
    check_packing(pack(df).collect(), ids)
    check_packing(pack(df, shard_tokens=500, window=64).collect(), ids, 64)
    assert pack(empty(spark)).count() == 0
    # repeated rows and null ids are all packed
    all_rows = documents(spark)
    assert pack(all_rows).filter("start = 0").count() == all_rows.count()


RECALL = 0.9


def test_packing_retrieves_similar_documents(spark):
    import numpy as np

    from txgraph.llm.packing import ShardIndex

    docs = [np.array(x, "<u4") for x in ([1, 2, 3, 4], [9, 9, 8], [3, 4, 5], [7, 8, 9])]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=10)
    index = ShardIndex(docs, df, 4, 3.5)
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == [2]
    assert set(index.neighbours(1, np.array([True, False, True, True])).tolist()) == {3}


def test_packing_keeps_large_ids_beside_missing_ones(spark):
    from txgraph.llm.packing import pack

    big = 1 << 53
    rows = [(big + k, f"text number {k} of some") for k in (1, 3, 5, 7)] + [(None, "no id"), (None, "text number 1 of some")]
    got = pack(documents(spark, rows)).collect()
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == [big + 1, big + 3, big + 5, big + 7]
    assert sum(r.doc_id is None for r in got if r.start == 0) == 2


def test_shards_hold_what_a_seed_retrieves(spark):
    """Neighbours from a document's own shard against those from an unsharded index: the best ones'
    scores add up to 0.9 or more, at two numbers of shards."""
    import random

    import numpy as np

    from txgraph.llm import packing as P

    rnd = random.Random(8)
    names = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)]
    docs = []
    for topic in range(150):
        own = rnd.sample(names, 12)
        docs += [[x for _ in range(40) for x in rnd.choices([rnd.choice(own), rnd.choice(names[:300])], [1, 3])]
                 for _ in range(8)]
    number = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in d]) for d in docs]
    df = np.zeros(len(number), np.int64)
    for d in ids:
        df[np.unique(d)] += 1
    mean = float(np.mean([len(d) for d in ids]))
    whole = P.ShardIndex(ids, df, len(ids), mean)
    term = [P.weightiest(d, P._idf(df, len(ids)), mean) for d in ids]
    totals = {}
    for t, d in zip(term, ids):
        totals[t] = totals.get(t, 0) + len(d)

    def best(index, seed, among):
        """Score, in the whole index, of the best neighbour that lies in ``among``."""
        unused = among.copy()
        unused[seed] = False
        hits = index.neighbours(seed, unused)
        return float(index.score[hits[0]]) if len(hits) else 0.0

    for shard_tokens in (len(docs) * 40 // 8, len(docs) * 40 // 40):
        first, count = P.shard_plan(totals, len(df), shard_tokens)
        shard = np.array([first[t] + k % count[t] for k, t in enumerate(term)])
        assert len(set(shard)) >= 4
        sizes = np.bincount(shard) * 40
        assert sizes.max() <= 2.5 * shard_tokens
        everyone = np.ones(len(ids), bool)
        got = sum(best(whole, s, shard == shard[s]) for s in range(0, len(ids), 7))
        assert got >= RECALL * sum(best(whole, s, everyone) for s in range(0, len(ids), 7))
