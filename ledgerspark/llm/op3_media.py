"""Operator 3: media columns - texts as PNG images in a binary column, read back and hashed.

A payload (UTF-8, zero bytes appended up to a positive multiple of 64) becomes an 8-bit grey image 64 samples wide.
The writer picks a filter for every row among none, left and up by the least sum of absolute differences; the reader
tests the mark, every chunk's CRC-32 and zlib's own checksum, and undoes all five filters with numpy.  The feature is
a hash of the low-frequency cosine coefficients of the image, averaged down to 32 by 32.

Cases: null text is the empty text, one row of 64 zero samples; an empty table gives an empty result; repeated rows
and null ids are kept row by row; equal texts get equal values; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, text_bytes

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, LEFT, UP, AVERAGE, PAETH = range(5)

WIDTH, GRID, KEPT = 64, 32, 8
#: Compressed bytes in one chunk at most.
CHUNK = 1 << 16


class BadImage(ValueError):
    """A stored image that is cut short, altered or of another kind."""


def padded(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload with zero bytes up to a positive multiple of the width."""
    return payload + bytes(-len(payload) % width or (0 if payload else width))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as PNG."""
    height, width = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    tried = np.stack([samples, left, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2)
    best = cost.argmin(0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(height)]
    packed = zlib.compress(lines.tobytes(), 3)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise BadImage("unknown filter")
    alone = np.flatnonzero(kinds == LEFT)
    out[alone] = np.cumsum(out[alone], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(kinds)], strict=True):
        kind = kinds[a]
        if kind == UP:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for y in range(a, b):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                row, before, corner = out[y].tolist(), 0, 0
                for x, over in enumerate(above):
                    if kind == AVERAGE:
                        guess = (before + over) >> 1
                    else:
                        near = {before: abs(over - corner)}
                        near.setdefault(over, abs(before - corner))
                        near.setdefault(corner, abs(before + over - 2 * corner))
                        guess = min(near, key=near.__getitem__)
                    before, corner = (row[x] + guess) & 255, over
                    row[x] = before
                out[y] = row
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG; anything amiss raises :class:`BadImage`."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadImage("cut short")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(body) != size or len(check) != 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise BadImage(f"checksum of chunk {kind!r} does not hold")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise BadImage("not an 8-bit grey image without interlace")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BadImage(str(e)) from e
    width, height = head[:2]
    if len(raw) != height * (width + 1):
        raise BadImage("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@functools.cache
def cosines(kept: int = KEPT, size: int = GRID) -> np.ndarray:
    """The lowest ``kept`` rows of the cosine transform of ``size`` points."""
    k, x = np.arange(kept)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * size))


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: which of the 8 by 8 lowest coefficients lie above their median, the mean left out of it."""
    height, width = samples.shape
    sums = np.zeros((height + 1, width))
    np.cumsum(samples, axis=0, out=sums[1:])
    at = np.arange(GRID + 1) * (height / GRID)
    low = np.minimum(at.astype(np.int64), height - 1)
    level = sums[low] + (at - low)[:, None] * samples[low]
    grid = np.diff(level, axis=0).reshape(GRID, GRID, -1).mean(2) * (GRID / height)
    low = (cosines() @ grid @ cosines().T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as images: (id, n_bytes, media binary)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        media = [write_png(np.frombuffer(padded(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_batches(docs.select(id_col, text_bytes(text_col)), rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored images back: digests of payload and stored form, and the cosine hash."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in batch.column(2).to_pylist():
            samples = read_png(data)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(media.select(id_col, "n_bytes", "media"), rows, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
