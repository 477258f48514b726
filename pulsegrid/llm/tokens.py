"""Byte-level BPE ids of whole texts with the tokenizers library.

Building the library's offset-tracking ``Encoding`` costs far more than the merges, so ordinary texts
are cut into pre-tokens here and each distinct pre-token goes once through the tokenizer's own model.
A text with any character outside ``PLAIN``, or with a special token's string, goes whole through
``encode_batch``; the two ways give equal ids (tests/llm/test_tokens.py).
"""

from __future__ import annotations

import re
from array import array

from pulsegrid.llm.common import KEPT

TOKENIZER = "byte_bpe_50k.json"
#: Pre-tokens remembered by one worker; further ones are encoded anew each time.
REMEMBERED = 1_000_000
#: Characters on which the pattern below and the tokenizer's own agree: printable ASCII, line ends and
#: tabs, Latin letters with marks.
PLAIN = re.compile(r"[\x20-\x7e\n\r\tÀ-ÖØ-öø-ſ]*\Z")
#: The tokenizer's pattern over PLAIN characters, its classes written out and words first, which is faster;
#: alternatives that change places never start with the same character.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[ \n\r\t]+(?![^ \n\r\t])|[ \n\r\t]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself where printable, else 256 upwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces(dict):
    """Ids of pre-tokens, as remembered or, the first time, from the tokenizer's model; it holds no reference to its encoder."""

    def __init__(self, tokenize, remembered: int):
        self.tokenize, self.remembered, self.letters = tokenize, remembered, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        # printable ASCII but the space stands for itself
        simple = piece.isascii() and piece.isprintable()
        word = piece.replace(" ", self.letters[32]) if simple else piece.encode().decode("latin-1").translate(self.letters)
        found = array("I", [t.id for t in self.tokenize(word)]).tobytes()
        if len(self) < self.remembered:
            self[piece] = found
        return found


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Pieces(self.tokenizer.model.tokenize, remembered)

    def ids(self, text: str) -> bytes:
        if PLAIN.match(text) is None or any(s in text for s in self.special):
            whole = self.tokenizer.encode_batch([text], add_special_tokens=False)[0].ids
            return array("I", whole).tobytes()
        return b"".join(map(self.known.__getitem__, PIECES.findall(text)))


_ENCODERS: dict[tuple[str, int], Encoder] = KEPT.setdefault("tokens", {})


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder; Python workers are reused, and so is what it remembers, ``remembered`` pre-tokens at most."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]
