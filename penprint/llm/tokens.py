"""Token ids of a public tokenizer file, encoded piece by piece.

A byte-level BPE splits a text into pieces first and never merges across them.
Where single blanks and line feeds stand between ink, a piece starts at every
blank, and a line feed is a piece of its own.  Such a text of well-known letters,
ASCII digits and common marks is cut into its pieces here, and only pieces not
met lately go through the library's merges.  With other characters it is cut at
its blanks and line feeds, and each such word is encoded once.  Texts with other
white space are encoded whole.  The ids equal those of ``Tokenizer.encode`` (tested).

A worker keeps its tables for the next task, in bounded size, and lets go of them
when it has encoded nothing for a while: the same worker then serves other steps.
"""

from __future__ import annotations

import os
import re
import sys
import threading
import time

import numpy as np

_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_OTHER = tuple(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")
_MOST = 250_000  # entries of a table's generation
_IDLE = 10.0     # seconds

# Letters and marks that every version of Unicode classes alike
# (Latin, Greek, Cyrillic, Arabic, kana, Han and Hangul), and the pattern by which
# the byte-level tokenizer parts a text, on those characters only.
_LETTER = ("A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01bf\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff"
           "\u0621-\u063a\u0641-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3")
_MARK = "\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u3001\u3002\u300c\u300d\uff01\uff0c\uff1a\uff1b\uff1f"
_SIMPLE = re.compile(rf"[\n\x20-\x7e{_LETTER}{_MARK}]+").fullmatch
_PIECES = re.compile(rf"\n|'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+").findall


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself where it is printable Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(0x100 + i) for i, b in enumerate(hidden)}}


def _plain(text: str) -> bool:
    """Only single blanks and line feeds, between ink."""
    return not (text[0].isspace() or text[-1].isspace() or any(c in text for c in _DOUBLE)
                or any(c in text for c in _OTHER))


def _raw(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


class _Table(dict):
    """Piece or word -> its ids.  The entries of two generations are kept; one that
    is met again moves to the newer one."""

    def __init__(self, find):
        self.find, self.old = find, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.find(key)
        self[key] = got
        return got

    def age(self) -> None:
        if len(self) > _MOST:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit arrays.  The strings of
    special tokens inside a text are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.names = self.tokenizer.model, _byte_names()
        self.pieces = _Table(self._piece)  # with their leading blank
        self.words = _Table(self._word)    # "w": ids of " w"; "\nw": ids of a line feed and w
        self.feed = self._all("\n")
        self.used = time.monotonic()

    def _all(self, text: str) -> bytes:
        return _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.names)
        return _raw([t.id for t in self.model.tokenize(spelled)])

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES(text)))

    def _word(self, word: str) -> bytes:
        first = word[0] == "\n"
        text = word[1:] if first else " " + word
        got = self._cut(text) if _SIMPLE(text) else self._all(text)
        return self.feed + got if first else got

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _one(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if not _plain(text):
            return self.whole(text)
        if _SIMPLE(text):
            return np.frombuffer(self._cut(text), "<u4")
        words = ("\n" + text.replace("\n", " \n")).split(" ")
        # without the line feed put before the first word
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4", offset=4)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            self.pieces.age(), self.words.age()
            out.append(self._one(text))
        self.used = time.monotonic()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process, until it lies idle."""
    got = _ENCODERS.get(path)
    if got is None:
        got = _ENCODERS[path] = Encoder(path)
        _drop_idle(path)
    got.used = time.monotonic()
    return got


def _drop_idle(path: str) -> None:
    """Forget an encoder that was not used for ``_IDLE`` seconds, else look again
    later.  A task that holds it is not disturbed."""
    held = _ENCODERS.get(path)
    left = held.used + _IDLE - time.monotonic() if held else 0
    if left <= 0:
        _ENCODERS.pop(path, None)
        return
    later = threading.Timer(left, _drop_idle, [path])
    later.daemon = True
    later.start()


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
