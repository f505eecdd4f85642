"""Byte-level BPE ids for whole texts, with the word-level work remembered between texts.

The ids are those of the ``tokenizers`` library. A byte-level BPE file cuts a text into pieces by a fixed pattern and merges
bytes inside each piece only, so the ids of a text are the ids of its pieces in order. Encoding a piece is dear and most
pieces come back, so a worker keeps the ids of short pieces and of the stretches between spaces, up to a fixed number.
What is not kept is encoded again: the memory bounds speed, never results.
"""

from __future__ import annotations

import array
import json
import os
import sys

import regex

#: The piece pattern of byte-level BPE files with ``use_regex``.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

KEPT_PIECES = 300_000
KEPT_CHUNKS = 300_000
LONGEST_KEPT = 48


def tokenizer_path(name: str) -> str:
    """``name`` is a path, or the file name of an installed public tokenizer."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in such files: printable Latin-1 for itself, the others from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return {b: chr(b if b in printable else 256 + next(rest)) for b in range(256)}


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self.model, self.chars = model, _byte_characters()

    def __missing__(self, piece: str) -> bytes:
        ids = array.array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.chars))])
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(self) < KEPT_PIECES and len(piece) <= LONGEST_KEPT:
            self[piece] = out
        return out


class _Unsafe(Exception):
    """A space here follows white space, so a piece may span it."""


class _Chunks(dict):
    """Stretch between two spaces -> ids of a space and that stretch."""

    def __init__(self, pieces: _Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[-1].isspace():
            raise _Unsafe
        out = b"".join(map(self.pieces.__getitem__, PIECE.findall(" " + chunk)))
        if len(self) < KEPT_CHUNKS and len(chunk) <= LONGEST_KEPT:
            self[chunk] = out
        return out


class Encoder:
    """Encode texts to little-endian unsigned 32-bit ids; none are put around a text.

    With ``escape`` the spelling of a special token in a text is text like any other. Without it, as is the library's default,
    it becomes that token: a text that holds one goes through the library whole.
    """

    def __init__(self, name: str, escape: bool = True):
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = escape
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        special_only = all(t.get("special") for t in spec.get("added_tokens", []))
        self.by_piece = byte_level and not spec.get("normalizer") and special_only and spec["model"]["type"] == "BPE"
        self.whole = [] if escape else [t["content"] for t in spec.get("added_tokens", [])]
        if self.by_piece:
            self.pieces = _Pieces(self.tokenizer.model)
            self.chunks = _Chunks(self.pieces)

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(t in text for t in self.whole):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        head, *rest = text.split(" ")
        try:
            # a piece holds a space at its start, or white space only: where a space follows other text, a piece begins
            if rest and (not head or head[-1].isspace()):
                raise _Unsafe
            last = rest.pop() if rest and (not rest[-1] or rest[-1][-1].isspace()) else None
            tail = b"" if last is None else b"".join(map(self.pieces.__getitem__, PIECE.findall(" " + last)))
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(head))) + b"".join(map(self.chunks.__getitem__, rest)) + tail
        except _Unsafe:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, escape: bool = True) -> Encoder:
    """The worker's encoder of this file; it stays for the worker's next tasks."""
    if (name, escape) not in _encoders:
        _encoders[name, escape] = Encoder(name, escape)
    return _encoders[name, escape]
