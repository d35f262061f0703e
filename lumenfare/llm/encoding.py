"""Whole-text token ids through the tokenizers library, with a bounded memory of words already encoded.

Both tokenizer kinds cut a text before they merge: where a single space or line feed stands between two non-spaces, no
token spans that place. So the words between are encoded on their own and remembered. A text with other white space,
two such characters in a row, one at an end, or a special token's string goes to the library whole.
"""

from __future__ import annotations

import struct

import numpy as np

from lumenfare.llm.common import forget, kept

#: Words remembered by one Python worker, and letters of such a word. Half of them are older: past the other half, the
#: older ones are forgotten that were not asked for again.
REMEMBERED, SHORT = 1 << 20, 64
#: Marks that stand together behind a word as one pre-token, and how many of them are looked up together.
MARKS, MOST_MARKS = ".,!?;:#$%&*", 8
_ODD = ["\t", "\x00", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "  ", "\n\n", " \n", "\n ", "<|"]
_ODD_WIDE = ["\x85", "\xa0", " ", "᠎", *map(chr, range(0x2000, 0x2010)), " ", " ", " ", " ", "　", "﻿"]


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


class _Words(dict):
    """word -> ids as little-endian uint32 bytes, found out when first asked for."""

    def __init__(self, tokenizer, prefix: str, lower: bool):
        self.tokenizer, self.prefix, self.lower = tokenizer, prefix, lower
        self.lead = prefix.translate(_LETTERS)
        self.older: dict[str, bytes] = {}
        self.tokenize = tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {}

    def _any(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= REMEMBERED // 64:
                self.marks.clear()
            self.marks[marks] = self._any(marks)
        return self.marks[marks]

    def age(self) -> None:
        if len(self) > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        if word in self.older:
            ids = self[word] = self.older.pop(word)
            return ids
        core = word.rstrip(MARKS)
        plain = core.isascii()
        low = core.lower() if self.lower else core
        # Latin letters whose lower case is letters too are one pre-token of the model, and marks behind them another.
        if not (core.isalpha() and (plain or max(core) < "ɐ" and low.isalpha())) or len(word) - len(core) > MOST_MARKS:
            ids = self._any(self.prefix + word)
        elif core != word:
            ids = self[core] + self._mark(word[len(core) :])
        elif low != core:
            ids = self[low]
        else:
            pieces = [t.id for t in self.tokenize(self.lead + (low if plain else low.encode().decode("latin-1").translate(_LETTERS)))]
            ids = struct.pack(f"<{len(pieces)}I", *pieces)
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class Encoder:
    """encode(texts) gives each text's ids as little-endian uint32 bytes; null is empty."""

    def __init__(self, path: str, spaced: bool):
        """spaced: a word's ids depend on a space before it (byte-level kind); else case and white space are dropped."""
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.first = _Words(self.tokenizer, "", not spaced)
        self.later = _Words(self.tokenizer, " ", False) if spaced else self.first
        self.line = self.first._any("\n") if spaced else b""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif t[0] in " \n" or t[-1] in " \n" or any(x in t for x in _ODD) or not t.isascii() and any(x in t for x in _ODD_WIDE):
                out.append(self.first._any(t))
            elif self.spaced:
                lines = []
                for line in t.split("\n"):
                    head, *rest = line.split(" ")
                    lines.append(self.first[head] + b"".join(map(self.later.__getitem__, rest)))
                out.append(self.line.join(lines))
            else:
                out.append(b"".join(map(self.first.__getitem__, t.split())))
        self.first.age()
        self.later.age()
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}
kept.append(_encoders)


def encoder(path: str, spaced: bool) -> Encoder:
    """One Encoder per worker process and file, until another operator's task comes to the process."""
    forget(_encoders)
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]
