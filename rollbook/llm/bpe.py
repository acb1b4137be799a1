"""Byte-level BPE from a public ``tokenizer.json``, with a cache of words."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import regex
import tiktoken

from rollbook.llm.common import per_process

#: The pattern that splits text before the merges (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and their ids that a worker keeps; past it the cache starts anew.
CACHED_WORDS = 100_000


def _class(wanted) -> str:
    """Characters of the basic plane for which ``wanted`` holds, as ranges of a character class."""
    parts, start = [], None
    for code in range(0x10001):
        inside = code < 0x10000 and wanted(chr(code))
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            parts.append(f"\\u{start:04x}-\\u{code - 1:04x}")
            start = None
    return "".join(parts)


def _patterns():
    """PATTERN for texts of the basic plane in the faster engine, and as it stands for all others."""
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    digit = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = _class(lambda c: regex.match(r"\s", c) is not None)
    plain = re.compile(
        f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"
    )
    return plain, regex.compile(PATTERN), re.compile(f"[^{space}][{space}]"), re.compile(f"(?s:.*)[^{space}]([{space}])")


def split_patterns():
    """A function from a text to the words that merges or pieces work on; joined they are the text."""
    plain, full, _, _ = per_process("patterns", _patterns)
    astral = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: (plain if text.isascii() or not astral(text) else full).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(content: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """Byte strings with their ids, and added tokens with theirs, from the text of a tokenizer.json.

    Only byte-level BPE without normalizer whose ids follow the order of the merges
    is taken, and added tokens without white space and options; else ValueError.
    """
    spec = json.loads(content)
    model, letters = spec["model"], byte_alphabet()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    follows = all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges))
    options = any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not follows or options or spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel":
        raise ValueError("not a plain byte-level BPE")
    if spec["pre_tokenizer"].get("add_prefix_space") or any(not t or re.search(r"\s", t) for t in added):
        raise ValueError("prefix spaces and added tokens with white space are not supported")
    return ids, added


class _Words(dict):
    """Word -> its ids, packed."""

    def __init__(self, encode, kind):
        super().__init__()
        self.encode, self.kind = encode, kind

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = array(self.kind, self.encode(word.encode())).tobytes()
        return ids


class ByteBpe:
    """Encode to packed little-endian ids and back, as the tokenizers library does without special tokens added."""

    def __init__(self, content: bytes, control: tuple[str, ...] = ()):
        """``control``: further strings that are tokens of their own, with the ids after the vocabulary's."""
        ranks, self.added = vocabulary(content)
        free = 1 + max([*ranks.values(), *self.added.values()])
        self.added |= {c: free + k for k, c in enumerate(control) if c not in self.added}
        self.kind = "H" if max([*ranks.values(), *self.added.values()]) < 1 << 16 else "I"
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(self.core._core_bpe.encode_single_piece, self.kind)
        _, _, self.first_gap, self.last_gap = per_process("patterns", _patterns)
        self.words_in = split_patterns()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.bytes_of = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in self.added.items()}
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)])
        self.digits = {i: str(i).encode() for i in self.bytes_of}

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        if any(t in text for t in self.added):
            parts = self.split.split(text)
            return b"".join(
                array(self.kind, [self.added[p]]).tobytes() if k % 2 else self.encode_plain(p) for k, p in enumerate(parts)
            )
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.words_in(text)))

    def ids(self, packed: bytes) -> array:
        out = array(self.kind)
        out.frombytes(packed)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the tokens, as the decoder joins them before it reads UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: array, step: int = 1 << 20) -> str:
        """SHA-256 of the decimal ids joined by commas, a stretch at a time."""
        out = hashlib.sha256()
        for k in range(0, len(ids), step):
            out.update((b"," if k else b"") + b",".join(map(self.digits.__getitem__, ids[k : k + step])))
        return out.hexdigest()
