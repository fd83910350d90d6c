"""Exact encoding with the tokenizers library, each distinct word encoded once a worker.

The byte-level pre-tokenizer never lets a piece run from a character that is not
white space into white space, and matches without looking behind. A cut between
two such characters therefore never changes the ids, so a text is cut before its
white space and the ids of each distinct word, looked up or encoded, are joined.
"""

from __future__ import annotations

import os
import re
from array import array

#: White space as the pre-tokenizer sees it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
SAFE_CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_INNER_WHITE = re.compile(f".[{WHITE}]", re.S)
CACHED_WORDS = 500_000
_PLAIN = re.compile("(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,./:;=?@-]*)")
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up in order.
BYTE_OF = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
BYTE_OF |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in BYTE_OF)}
_SYMBOLS = {b: c for c, b in BYTE_OF.items()}


def load(path: str):
    """The tokenizer of a file with truncation and padding off, as they are where unused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Odd(Exception):
    """A word with white space inside: its text needs the careful cut."""


class _Known(dict):
    """Word -> ids. Full after ``held`` words; later words are encoded each time they come.

    A new plain word (Latin letters, then ASCII marks) is two of the
    pre-tokenizer's pieces by its pattern, so the library's model encodes them
    directly; any other word goes through the whole library.
    """

    def __init__(self, tokenizer, held: int, held_pieces: int):
        self.tokenizer = tokenizer
        self.held, self.held_pieces = held, held_pieces
        self.pieces: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            symbols = piece.encode().decode("latin-1").translate(_SYMBOLS)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()
            if len(self.pieces) < self.held_pieces:
                self.pieces[piece] = found
        return found

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:
            line, letters, marks = plain.groups()
            ids = self.piece(letters)
            if line:
                ids = self.piece(line) + ids
            if marks:
                ids += self.piece(marks)
        elif word and (word in " \n" or _INNER_WHITE.search(word)):
            raise _Odd
        else:
            ids = self.ids(word)
        if len(self) < self.held:
            self[word] = ids
        return ids


class WordEncoder:
    """Texts -> ids as native (little-endian) unsigned 32-bit integers, equal to the library's."""

    def __init__(self, path: str, held: int = CACHED_WORDS, pieces: int = CACHED_WORDS):
        self.known = _Known(load(path), held, pieces)

    def encode(self, text: str) -> bytes:
        if "\0" not in text:
            try:
                return b"".join(map(self.known.__getitem__, text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")))
            except _Odd:
                pass
        return b"".join([self.known.get(u) or self.known.ids(u) for u in _UNITS.findall(text)])


_encoders: dict[tuple[str, int, int], WordEncoder] = {}


def encoder(path: str, held: int = CACHED_WORDS, pieces: int = CACHED_WORDS) -> WordEncoder:
    """The worker's encoder of a file; a worker keeps it from task to task."""
    key = path, held, pieces
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]
