"""Token ids of whole texts, one distinct word at a time.

The vocabulary's own pipeline cuts at white space and never joins across it, so a text's ids are its words' ids in a
row. Each distinct word is encoded once and kept (up to ``keep`` words per Python worker). Words of ASCII and
precomposed Latin letters go through the same steps (lower case, cut, byte alphabet) in Python and straight to the library's BPE model; any
other word, and words that hold a special token, go through the library's full pipeline.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex

#: The pre-tokenizer's pattern in the vocabulary file (fixed value).
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile("[!-~À-ÖØ-öø-įĴ-ňŊ-ž]+")


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    _own: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        special = [re.escape(t.content.encode()) for t in self.full.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special) or b"(?!)").search
        self.table = byte_alphabet()
        self.keep, self.words, self.parts = keep, {}, {}

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        """One per worker process: the cache serves all its tasks."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.table)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if not PLAIN.fullmatch(text) or self.special(word):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        low, out = text.lower(), b""
        for part in (low,) if low.isalpha() else CUT.findall(low):
            ids = self.parts.get(part)
            if ids is None:
                ids = self._part(part)
                if len(self.parts) < self.keep:
                    self.parts[part] = ids
            out += ids
        return out

    def encode(self, texts: list[bytes | None]):
        """Little-endian uint32 ids of each text, as bytes."""
        for text in texts:
            words = (text or b"").split()
            known = self.words
            try:
                yield b"".join(map(known.__getitem__, words))
            except KeyError:
                if len(known) > self.keep:  # frequent words come back at once
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = self.word(w)
                yield b"".join(map(known.__getitem__, words))
