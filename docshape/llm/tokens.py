"""Exact token ids of the word-end BPE vocabulary, word by word.

Ids equal those of the public tokenizer file.  Texts of common characters are
cut into words here and each new word is merged once and then looked up;
texts with any other character go through the tokenizers library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: Characters for which lower-casing, NFC and the character classes are simple: white space, printable ASCII and Latin letters and signs.
_PLAIN = [(0x09, 0x0D), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x12F), (0x131, 0x24F), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]
#: Words kept by a worker at most; then it starts anew.
KEPT_WORDS = 400_000


def _plain_chars() -> list[str]:
    return [chr(c) for a, b in _PLAIN for c in range(a, b + 1)]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _plain_chars() if unicodedata.category(c)[0] == kind)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free character from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds(dict):
    """word: its ids as little-endian unsigned 32-bit integers; fills itself.

    A word's end is marked by a byte that no UTF-8 text has; merging it to the last byte comes first, then the
    vocabulary's merges by rank, lowest and leftmost first."""

    def __init__(self, path: str):
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))["model"]
        byte_of, end = _byte_chars(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            tail = token.endswith(end)
            return bytes(byte_of[c] for c in (token[: -len(end)] if tail else token)) + b"\xff" * tail

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranks = {bytes([b, 0xFF]): b for b in range(256)}
        for i, (a, b) in enumerate(merges):
            ranks.setdefault(raw(a) + raw(b), 256 + i)
        for b in range(256):
            ranks[bytes([b])] = 256 + len(merges) + b
        known = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t.removesuffix(end))}
        self._id = np.zeros(max(ranks.values()) + 1, "<u4")
        for token, rank in ranks.items():
            self._id[rank] = known.get(token, 0)
        self._bpe = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self._id[self._bpe.encode_single_piece(word.encode() + b"\xff")].tobytes()
        self[word] = ids
        return ids


class Encoder:
    """text -> ids as little-endian unsigned 32-bit integers, without special tokens."""

    def __init__(self, path: str):
        letters, numbers = _class("L"), _class("N")
        self._find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall
        self._other = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _PLAIN) + "]").search
        self._words, self._path, self._whole = WordIds(path), path, None

    def __call__(self, text: str) -> bytes:
        if self._other(text):
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self._path)
                self._whole.encode_special_tokens = True
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._words.__getitem__, self._find(text.lower())))
