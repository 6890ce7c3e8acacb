"""SentencePiece model files: their protobuf, and where their merges provably never reach across.

Only the fields that encoding needs are read.  :func:`splits_at_marks` looks at the vocabulary alone: if no piece holds a
white-space mark after another character, no merge can join the end of one word with the mark that opens the next,
so the pieces of a text are the pieces of its pre-tokens, one after the other.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

MARK = "▁"
# fixed values: piece types and model types of the file format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, type
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message: integers, or the bytes of the rest."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a model file: wire type {wire}")
        yield key >> 3, value


def read_model(path: str) -> Model:
    """The model in the file ``path``."""
    with open(path, "rb") as file:
        return parse_model(file.read())


def parse_model(data: bytes) -> Model:
    """The model in serialised form."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:  # a piece
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:  # how it was trained
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.suffix_mark = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 44:
                    model.unk_surface = v.decode()
        elif number == 3:  # normaliser
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze_spaces = bool(v)
                elif n == 5:
                    model.escape_spaces = bool(v)
    if not model.pieces:
        raise ValueError("not a model file: it has no pieces")
    return model


def splits_at_marks(model: Model) -> bool:
    """Whether the pieces of a normalised text are those of its parts, cut in front of every run of marks.

    The proof needs: spaces escaped as marks that stand in front of words, a mark put in front of every text, no other
    normalising, and no piece with a mark behind another character.
    """
    texts = [t for t, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
    return plain_normaliser(model) and not model.suffix_mark and not any(MARK in t.lstrip(MARK) for t in texts)


def pretokens(text: str) -> list[str]:
    """The parts of a non-empty text, each without its first mark."""
    marked = text.replace(" ", MARK)
    if MARK + MARK not in marked and marked[0] != MARK:
        return marked.split(MARK)
    return [part[1:] for part in _PART.findall(MARK + marked)]


_PART = re.compile(f"{MARK}+[^{MARK}]*")


def plain_normaliser(model: Model) -> bool:
    """Whether normalising is only a mark in front and marks for spaces."""
    return not model.charsmap and model.dummy_prefix and not model.squeeze_spaces and model.escape_spaces
