"""Token ids of a public byte-level BPE vocabulary, through the tokenizers library.

The library's model is asked once for each different piece of text between its own split points; ids of a text are those
of its pieces side by side. The split is done here for texts of Latin characters, for which its classes are spelled out;
any other text, and one that holds a token added to the vocabulary (such as its end-of-text mark), goes to the library
whole, so ids are the library's in every case.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Texts with characters from here on are not split here.
LIMIT = 0x250
FIRST_BYTE = chr(LIMIT).encode()[0]
#: White space below LIMIT beside the blank.
OTHER_SPACE = "\t\n\v\f\r\x85\xa0"
SIGNS = frozenset(".,;:!?)")


def _chars(wanted) -> str:
    return "".join(re.escape(chr(c)) for c in range(LIMIT) if wanted(unicodedata.category(chr(c))))


def _pattern() -> re.Pattern:
    """The split of byte-level BPE, `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`, below LIMIT."""
    letter, number = _chars(lambda c: c[0] == "L"), _chars(lambda c: c[0] == "N")
    space = "\\t-\\r \\x85\\xa0"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_names() -> dict[int, str]:
    """Byte-level BPE names a byte by itself where it is printable, else by the next character from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Table(dict):
    """Keeps what `make` gives for a key; texts over LONG characters are not kept, and beyond MOST keys it starts anew."""

    MOST, LONG = 800_000, 64

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        made = self.make(text)
        if len(text) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[text] = made
        return made


class Ids(Table):
    """A word after one blank -> the ids of blank and word, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__(self.word)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.names = _byte_names()
        #: The bytes of each id.
        self.bytes = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()))]
        #: Texts that hold one of these go to the library whole: it gives them ids of their own.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Table(self.piece)
        self.split = _pattern().findall
        self.beyond = re.compile(f"[^\\x00-{chr(LIMIT - 1)}]").search

    def whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def named(self, piece: str) -> bytes:
        ids = self.bytes
        return b"".join([ids[t.id] for t in self.model(piece)])

    def piece(self, text: str) -> bytes:
        plain = text[1:].isascii() and text[1:].isalpha() and text[0] == " "
        return self.named("\u0120" + text[1:] if plain else "".join(map(self.names.__getitem__, text.encode())))

    def word(self, word: str) -> bytes:
        """Words of letters, and those with one sign behind, need no split."""
        if word.isalpha():
            return self.named("\u0120" + word) if word.isascii() else self.piece(" " + word)
        if word[-1:] in SIGNS and word[:-1].isalpha():
            return self[word[:-1]] + self.pieces[word[-1]]
        return self.joined(" " + word)

    def joined(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def foreign(self, text: str) -> bool:
        """Whether a character is LIMIT or beyond; below, the first byte of no character passes that of LIMIT."""
        if text.isascii():
            return False
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return raw.max() >= FIRST_BYTE and self.beyond(text) is not None

    def of(self, text: str) -> bytes:
        if self.foreign(text) or any(t in text for t in self.added):
            return self.whole(text)
        # where white space stands beside a blank, a blank need not start a piece
        if "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER_SPACE):
            return self.joined(text)
        first, *words = text.split(" ")
        return self.joined(first) + b"".join(map(self.__getitem__, words))
