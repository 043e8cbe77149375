"""Operator 2, BPE encoding and decoding by traversal of a trie with shared prefixes.

The distinct words of a batch go into a trie over symbols (bytes; the last byte of a word
is another symbol than the same byte inside one, as the vocabulary marks word ends). Byte
pair encoding has a prefix property: the ids of a prefix of an encoding are the encoding
of that prefix. So a node needs only its *last token*, the one vocabulary entry that ends
here and may follow the last token of the node where it begins; a depth-first walk settles
every node from its ancestors, and each shared prefix is encoded once. A word's ids follow
from its node by stepping back from token to token.

Whether two tokens may stand side by side is decided from the merge ranks: going back
through how both were merged, no merge across the boundary may come before the merges that
use up its two sides (the leftmost first where ranks are equal).

Decoding maps ids to their vocabulary strings, joined by blanks, as the library does for a
file without a decoder.

Defined results: a null text counts as empty (0 tokens, the hash of nothing); every row
gives a row, repeated rows and null ids included; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm import vocab
from txgraph.llm.common import ship, slices

END = 256           # added to the last byte's value
_BYTES = [bytes([b]) for b in range(256)]
_PLAIN = re.compile(r"[!-~¡-ɏ]+")


def _reach(tokens: dict[bytes, int]) -> dict[bytes, int]:
    """Length of the longest entry for each last three bytes that entries have."""
    out: dict[bytes, int] = {}
    for t in tokens:
        if len(t) >= 3 and out.get(t[-3:], 0) < len(t):
            out[t[-3:]] = len(t)
    return out


class TrieBpe:
    """Encoder for a word-end-marked byte-level BPE file (``word_bpe_49k.json``)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        suffix = model["end_of_word_suffix"]
        if not suffix or vocab.segmenter(path) is not vocab.words:
            raise ValueError(f"not a word-end-marked BPE file: {path}")
        to_byte = vocab.byte_chars()
        self.strings = {i: s for s, i in model["vocab"].items()}
        # vocabulary entries inside a word and at its end, by their bytes
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for s, i in model["vocab"].items():
            body = s[: -len(suffix)] if s.endswith(suffix) else s
            if body and all(c in to_byte for c in body):
                (self.final if s.endswith(suffix) else self.inner)[bytes(map(to_byte.get, body))] = i
        self.reach_inner, self.reach_final = _reach(self.inner), _reach(self.final)
        self.merge: dict[tuple[int, int], int] = {}       # pair -> rank
        self.made: dict[int, tuple[int, int, int]] = {}   # token -> rank, left, right
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (model["vocab"][a], model["vocab"][b])
            self.merge[pair] = rank
            self.made[model["vocab"][a + b]] = (rank, *pair)
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.strings |= {i: s for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.pieces = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        lib = Tokenizer.from_file(path)
        self.normal, self.pre, self.to_byte = lib.normalizer, lib.pre_tokenizer, to_byte
        self.fits: dict[tuple[int, int], bool] = {}
        self.word_ids = vocab.Memo(self._encode_distinct, 400_000)

    # -- which tokens may be neighbours -------------------------------------------------
    def _side_by_side(self, a: int, b: int) -> bool:
        used_a = used_b = 1 << 60          # ranks of the merges that use a and b up
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < used_a and rank <= used_b:
                return False
            ra = self.made[a][0] if a in self.made else -1
            rb = self.made[b][0] if b in self.made else -1
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two merges; of equal ones the right was made last
            if ra > rb:
                used_a, a = ra, self.made[a][2]
            else:
                used_b, b = rb, self.made[b][1]

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            ok = self.fits[key] = self._side_by_side(a, b)
        return ok

    def _encode_distinct(self, words: list[bytes]) -> list[tuple]:
        got = self.encode_words(words)
        return [tuple(got[w]) for w in words]

    # -- the trie ------------------------------------------------------------------------
    def encode_words(self, distinct: list[bytes]) -> dict[bytes, list[int]]:
        """ids of each distinct word."""
        kids: list[dict[int, int]] = [{}]
        ends = []
        for w in distinct:
            node = 0
            last = len(w) - 1
            for i, s in enumerate(w):
                if i == last:
                    s += END
                nxt = kids[node].get(s)
                if nxt is None:
                    nxt = len(kids)
                    kids[node][s] = nxt
                    kids.append({})
                node = nxt
            ends.append(node)
        last_token, begins = [-1] * len(kids), [0] * len(kids)
        nodes: list[int] = [0]      # nodes from the root
        todo = [(0, b"", s, n) for s, n in kids[0].items()]
        inner, final, fits, may = self.inner, self.final, self.fits, self.may_follow
        reach_inner, reach_final = self.reach_inner, self.reach_final
        while todo:
            depth, path, sym, node = todo.pop()
            del nodes[depth + 1:]
            here = depth + 1
            nodes.append(node)
            if sym < END:
                tokens, path = inner, path + _BYTES[sym]
                longest = reach_inner.get(path[-3:], 2)
            else:
                tokens, path = final, path + _BYTES[sym - END]
                longest = reach_final.get(path[-3:], 2)
            # the longest vocabulary entry that ends here and may follow what is before it;
            # one that begins at the root stands alone, as every entry merges to itself
            for at in range(here - longest if here > longest else 0, here):
                t = tokens.get(path[at:])
                if t is None:
                    continue
                start = nodes[at]
                if not start:
                    last_token[node] = t
                    break
                key = (last_token[start], t)
                ok = fits.get(key)
                if ok or ok is None and may(*key):
                    last_token[node], begins[node] = t, start
                    break
            if sym < END:
                below = kids[node]
                if below:
                    todo.extend([(here, path, s, n) for s, n in below.items()])
        out = {}
        for w, node in zip(distinct, ends):
            ids = []
            while node:
                ids.append(last_token[node])
                node = begins[node]
            ids.reverse()
            out[w] = ids
        return out

    # -- segments ------------------------------------------------------------------------
    def _word_bytes(self, part: str) -> list[bytes]:
        if _PLAIN.fullmatch(part):
            return [p.encode() for p in self.pieces.findall(part.lower())]
        made = self.pre.pre_tokenize_str(self.normal.normalize_str(part))
        return [bytes(self.to_byte[c] for c in s) for s, _ in made]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """ids of texts; segments of a batch share one trie."""
        plan = []
        distinct: dict[bytes, None] = {}
        for s in segments:
            row = []
            for part in self.split_special.split(s) if "<|" in s else (s,):
                if part in self.special:
                    row.append(self.special[part])
                elif part:
                    got = self._word_bytes(part)
                    row.extend(got)
                    distinct.update(dict.fromkeys(got))
            plan.append(row)
        ids = self.word_ids.table([distinct])
        return [[i for p in row for i in ((p,) if isinstance(p, int) else ids[p])]
                for row in plan]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def pack_segments(self, segments: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded UTF-8) of segments."""
        return [(struct.pack(f"<{len(i)}I", *i), self.decode(i).encode())
                for i in self.encode_segments(segments)]


_loaded: dict[str, tuple] = {}


def _load(path: str):
    if path not in _loaded:
        bpe = TrieBpe(path)
        _loaded[path] = (bpe, vocab.Memo(bpe.pack_segments, 600_000))
    return _loaded[path]


def encode_texts(texts: list[str], path: str) -> list[tuple[bytes, bytes]]:
    """(packed ids, decoded UTF-8) of each text."""
    _, memo = _load(path)
    segmented = [vocab.words(t) for t in texts]
    known = memo.table(segmented)
    out = []
    for s in segmented:
        got = [known[x] for x in s]
        out.append((b"".join([g[0] for g in got]),
                    b" ".join([g[1] for g in got if g[1]])))
    return out


def bpe_encode(df: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id",
               text_col: str = "text", digests: bool = False,
               batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_tokens, ids array<int>, decoded string) of every row; with ``digests`` the
    SHA-256 of both in place of the values, so that only hashes leave the worker."""
    ship(df.sparkSession)

    def rows(batches):
        path = vocab.resolve(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(batch_bytes, list(map(len, texts))):
                got = encode_texts(texts[i:j], path)
                n = pa.array([len(x) // 4 for x, _ in got], pa.int64())
                if digests:
                    cols = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in got], pa.string())
                            for k in (0, 1)]
                else:
                    cols = [pa.array([struct.unpack(f"<{len(x) // 4}I", x) for x, _ in got],
                                     pa.list_(pa.int32())),
                            pa.array([y.decode() for _, y in got], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], n, *cols], names=[id_col, "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = ["string", "string"] if digests else ["array<int>", "string"]
    src = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(rows, f"`{id_col}` {kind}, n_tokens bigint, "
                          f"{names[0]} {kinds[0]}, {names[1]} {kinds[1]}")
