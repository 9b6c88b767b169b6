"""Reads and writes the SentencePiece model protobuf: pieces, scores, types, trainer and normaliser settings."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field, replace

#: Default place of the public BPE model with byte fallback; a parameter everywhere.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Model kinds and piece kinds of the format.
UNIGRAM, BPE = 1, 2
#: Shift of ranks in Zipf's law (Mandelbrot's form).
ZIPF_SHIFT = 2.7
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    normalizer: str = "identity"
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def min_score(self) -> float:
        return min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(field number, value) of one message; lengths-delimited values as bytes, fixed ones raw."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def parse(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
            if kind == UNKNOWN:
                model.unk_id = len(model.pieces) - 1
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 1:
                    model.normalizer = v.decode("utf-8")
                elif n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    return model


def _put(number: int, kind: int, value: bytes) -> bytes:
    return _number(number << 3 | kind) + (_number(len(value)) if kind == 2 else b"") + value


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def serialize(model: PieceModel) -> bytes:
    """The protobuf of a model, for tests and for handing a changed model to other libraries."""
    out = b""
    for piece, score, kind in model.pieces:
        body = _put(1, 2, piece.encode()) + _put(2, 5, struct.pack("<f", score)) + _put(3, 0, _number(kind))
        out += _put(1, 2, body)
    out += _put(2, 2, _put(3, 0, _number(model.kind)) + _put(35, 0, _number(model.byte_fallback)))
    flags = (model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces)
    norm = _put(1, 2, model.normalizer.encode()) + _put(2, 2, model.charsmap)
    norm += b"".join(_put(3 + k, 0, _number(bool(x))) for k, x in enumerate(flags))
    return out + _put(3, 2, norm)


def as_unigram(model: PieceModel) -> PieceModel:
    """A unigram model of the same pieces: log-probabilities by Zipf's law of the pieces' ranks, in sixteenths.

    A BPE model states no probabilities, only the order of its merges, which is nearly that of frequency. Sixteenths
    make sums of scores exact in floats, so that other implementations find the same best paths. Unigram models stay
    as they are.
    """
    if model.kind == UNIGRAM:
        return model
    ranked = sorted((-score, k) for k, (_, score, kind) in enumerate(model.pieces) if kind == NORMAL)
    total = sum(1 / (r + ZIPF_SHIFT) for r in range(len(ranked)))
    scores = {k: -round(16 * math.log((r + ZIPF_SHIFT) * total)) / 16 for r, (_, k) in enumerate(ranked)}
    pieces = [(piece, scores.get(k, score), kind) for k, (piece, score, kind) in enumerate(model.pieces)]
    return replace(model, pieces=pieces, kind=UNIGRAM)


def load(path: str = MODEL_PATH) -> tuple[bytes, PieceModel]:
    with open(path, "rb") as f:
        data = f.read()
    return data, parse(data)
