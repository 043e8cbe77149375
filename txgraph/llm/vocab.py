"""Vocabulary files and safe segmentation of texts (worker side, no Spark here).

A *segment* is a stretch of text whose encoding does not depend on its surroundings, so a
text's ids are its segments' ids one after the other and a repeated segment is encoded
once. Where segments may be cut follows from the vocabulary file's own rules:

* files that normalise white space away (``word_bpe_49k.json``): white space always ends
  a piece and yields none, so any blank or newline is a safe cut;
* byte-level files without such a rule (``byte_bpe_50k.json``): a run of blanks belongs to
  what follows it, so a cut is safe only *before* a blank or newline that follows a
  character that is not white space;
* any other file: no cut, the whole text is one segment.

Special strings never contain white space, so no cut falls inside one.
"""

from __future__ import annotations

import json
import os
import re

LONG_SEGMENT = 256     # longer segments are encoded but not remembered
MEMO_SEGMENTS = 400_000

_LED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]|[^\S \n]")
_LED_ANY = re.compile(r"[ \n]*[^ \n]+(?:(?<=[\s\x1c-\x1f])[ \n]+[^ \n]+)*(?:(?<=[\s\x1c-\x1f])[ \n]+)?|[ \n]+")


def resolve(name: str) -> str:
    """A path as it is; a bare file name within the installed public vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: str) -> list[str]:
    """Cuts at every blank and newline, which are dropped."""
    return [w for w in text.replace("\n", " ").split(" ") if w]


def led(text: str) -> list[str]:
    """Cuts before a run of blanks and newlines that follows a non-space character."""
    if _ODD_SPACE.search(text):
        return _LED_ANY.findall(text)
    return _LED.findall(text)


def whole(text: str) -> list[str]:
    return [text] if text else []


def segmenter(path: str):
    """The finest safe segmentation for the vocabulary file at ``path``."""
    if not path.endswith(".json"):
        return whole
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    norm, pre = j.get("normalizer"), j.get("pre_tokenizer") or {}
    parts = (norm or {}).get("normalizers", [norm] if norm else [])
    steps = [p.get("type") for p in parts]
    if (j.get("model", {}).get("type") == "BPE" and steps == ["NFC", "Replace", "Lowercase"]
            and parts[1].get("pattern") == {"Regex": "\\s+"}
            and [p.get("type") for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]):
        return words
    if (j.get("model", {}).get("type") == "BPE" and norm is None
            and pre.get("type") == "ByteLevel" and pre.get("use_regex")
            and not pre.get("add_prefix_space")):
        return led
    return whole


class Encoder:
    """ids of a list of segments by the file's own library, without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()

    def encode(self, segments: list[str]) -> list[list[int]]:
        if self.sentencepiece:
            return self.sp.encode(segments, num_threads=1)
        return [e.ids for e in self.tok.encode_batch_fast(segments, add_special_tokens=False)]

    def size(self) -> int:
        """Number of ids, added tokens included."""
        return self.sp.vocab_size() if self.sentencepiece else self.tok.get_vocab_size()

    def lengths(self, segments: list[str]) -> list[int]:
        if self.sentencepiece:
            return [len(x) for x in self.sp.encode(segments, num_threads=1)]
        return [len(e) for e in self.tok.encode_batch_fast(segments, add_special_tokens=False)]


def byte_chars() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1
    stands for itself, the others are numbered from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def rank_encoder(path: str):
    """A function from a text to the array of its ids for byte-level files whose ids are their
    merge ranks (then a rank-based library gives the same ids, faster), else None."""
    import public_tokenizers
    import tiktoken

    if segmenter(path) is not led:
        return None
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    ids, to_byte = j["model"]["vocab"], byte_chars()
    special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
    plain = {s: i for s, i in ids.items() if s not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
    if any(ids.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(plain) != 256 + len(merges):
        return None
    ranks = {bytes(to_byte[c] for c in s): i for s, i in plain.items()}
    enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens=special)
    return lambda text: enc.encode_to_numpy(text, allowed_special="all")


class SegmentTable(dict):
    """Packed ids of segments, made when first asked for; bounded, in two generations."""

    def __init__(self, make, limit: int = MEMO_SEGMENTS):
        super().__init__()
        self.make, self.half, self.older = make, limit // 2, {}

    def __missing__(self, segment: str):
        got = self.older.get(segment)
        if got is None:
            got = self.make(segment)
        if len(segment) <= LONG_SEGMENT:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[segment] = got
        return got


class Memo:
    """Bounded memory of what segments map to; lives as long as the worker.

    Two generations: when the younger is full it becomes the older, and what is met again
    moves over, so frequent segments stay."""

    def __init__(self, make, limit: int = MEMO_SEGMENTS):
        self.make, self.half, self.known, self.older = make, limit // 2, {}, {}

    def table(self, segmented: list[list[str]]) -> dict:
        """A dict that has every segment of these texts."""
        need = set()
        for s in segmented:
            need.update(s)
        if len(self.known) > self.half:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for s in need.difference(known):
            if s in older:
                known[s] = older[s]
            else:
                new.append(s)
        if not new:
            return known
        made = dict(zip(new, self.make(new)))
        long = [s for s in new if len(s) > LONG_SEGMENT]
        if not long:
            known.update(made)
            return known
        known.update((s, v) for s, v in made.items() if len(s) <= LONG_SEGMENT)
        return {**{s: known[s] for s in need.intersection(known)}, **made}
