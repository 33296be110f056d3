"""Media columns: texts' bytes as greyscale PNG images, read back with checksum tests, and hashes of their low frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import full_text, prepare

WIDTH = 64
#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """Rows under the PNG filters None, Sub or Up (0, 1, 2)."""
    out = image.copy()
    if kind == 1:
        out[:, 1:] -= image[:, :-1]
    elif kind == 2:
        out[1:] -= image[:-1]
    return out


def _entropy(x: np.ndarray) -> float:
    p = np.bincount(x.ravel(), minlength=256)
    p = p[p > 0] / x.size
    return float(-(p * np.log2(p)).sum())


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit greyscale image; of the filters None, Sub and Up the one with the least entropy."""
    height, width = image.shape
    tried = [filtered(image, k) for k in range(3)]
    kind = min(range(3), key=lambda k: (round(_entropy(tried[k]), 9), k))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, tried[kind]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Undoes PNG's five filters on 8-bit greyscale rows (filter type first); runs of one filter together."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    at, height = 0, len(rows)
    while at < height:
        end = at + 1
        while end < height and kinds[end] == kinds[at]:
            end = int(np.flatnonzero(np.append(kinds[end:], 255) != kinds[at])[0]) + end
        part, kind = out[at:end], int(kinds[at])
        above = out[at - 1] if at else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (3, 4):
            for row in part:
                left = corner = 0
                for x in range(len(row)):
                    up = int(above[x])
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        base = left + up - corner
                        guess = min((left, up, corner), key=lambda v: abs(base - v))
                    row[x] = left = (int(row[x]) + guess) & 255
                    corner = up
                above = row
        elif kind != 0:
            raise ValueError(f"unknown PNG filter {kind}")
        at = end
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Reads an 8-bit greyscale PNG; raises ValueError where a signature, length or checksum doesn't hold."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body, said = media[at + 8 : at + 8 + size], media[at + 8 + size : at + 12 + size]
        if len(said) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", said)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as bad:
        raise ValueError("broken zlib data") from bad
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong size")
    return unfiltered(raw.reshape(head[1], head[0] + 1))


_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest cosine frequencies of the image, at 32 x 32, exceed their median."""
    height, width = image.shape
    if height >= _SIDE:
        edges = np.arange(_SIDE) * height // _SIDE
        rows = np.add.reduceat(image, edges, axis=0, dtype=np.int64) / np.diff(np.append(edges, height))[:, None]
    else:
        rows = image[np.arange(_SIDE) * height // _SIDE].astype(np.float64)
    small = rows.reshape(_SIDE, _SIDE, width // _SIDE).mean(axis=2)
    low = (_COSINE @ small @ _COSINE.T).ravel()
    bits = np.round(low, 6) > np.round(np.median(low[1:]), 6)
    return np.packbits(bits).tobytes().hex()


def payload(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of WIDTH."""
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


_OUT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a PNG in a binary column."""
    prepare(docs.sparkSession)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            images = (np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH) for t in texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_png(x) for x in images], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes of media_table back and digests payload, stored form and features."""
    prepare(media.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, stored in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                image = decode_png(stored)
                back = image.tobytes()
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(image)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, _OUT)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text), from the stored PNG of its text.

    A null text counts as empty, whose payload is 64 zeros; a null doc_id is kept; repeated rows get equal results;
    other columns are ignored; an empty table gives none. Each text is a row of its own, so nothing is shuffled.
    """
    return media_features(media_table(docs))
