"""Media columns: payload bytes kept as lossless WebP pixels, and features of the pixels read back.

A payload is a text's UTF-8 bytes (null: none) with bytes 32 appended up to a positive multiple of 192: rows of 64
red-green-blue pixels. A payload of more than 16384 rows becomes several images, stored one after another. Every
payload is stored whole; equal texts give equal media and features. Repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm import webp
from skein.llm.common import map_batches, read, stored

ROW = 192


def to_media(payload: bytes) -> bytes:
    """One or more WebP files, one after another."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return b"".join(webp.encode_rgb(rows[lo : lo + webp.MAX_SIDE]) for lo in range(0, len(rows), webp.MAX_SIDE))


def from_media(media: bytes) -> np.ndarray:
    """The pixels (rows, 64, 4) of stored media."""
    found, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        found.append(webp.decode(media[at : at + size]))
        at += size
    return np.concatenate(found)


def feature(pixels: np.ndarray) -> str:
    """Row count, mean channels and a difference hash of the 64 columns' mean brightness."""
    sums = pixels[..., :3].sum(axis=0, dtype=np.int64)
    bright = sums.sum(axis=1)
    bits = np.packbits(np.append(bright[1:] > bright[:-1], bright[0] > bright[-1])).tobytes().hex()
    means = sums.sum(axis=0) // (pixels.shape[0] * pixels.shape[1])
    return f"{bits}-{''.join(f'{m:02x}' for m in means.tolist())}-{pixels.shape[0]}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, media = [], []
                for text in part.column(1).to_pylist():
                    data = (text or "").encode("utf-8")
                    sizes.append(len(data))
                    media.append(to_media(data + b" " * (-len(data) % ROW if data else ROW)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def read_media(kept: DataFrame) -> DataFrame:
    """What the stored media hold: payload digest and size, digest and size of the media, and the pixel feature."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc, n, media in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    pixels = from_media(media)
                    payload = np.ascontiguousarray(pixels[..., :3]).tobytes()
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(kept.select("doc_id", "n_bytes", "media"), run, schema)


def op9_media_webp(spark, sf_dir):
    """The media are written to the shared folder as a table, and what is read back is described."""
    return read_media(stored(encode_media(read(spark, sf_dir, "documents")), "media"))
