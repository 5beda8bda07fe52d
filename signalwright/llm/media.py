"""Media columns: texts as grayscale PNG images in binary columns, read back and hashed by their low frequencies.

A payload is laid out in rows of 64 samples of 8 bits; each row takes the PNG filter (none, left or up) with the least sum of
differences, the rows are one zlib stream, and every chunk has its checksum. The images are written as a Parquet table with a
binary column in the shared folder; reading one tests signature, checksums and sizes and undoes all five PNG filters with numpy. The
hash is that of a perceptual hash: the image averaged to 32 x 32, its cosine transform's lowest 8 x 8 frequencies, a bit for each above
their median.

Defined results: a null or empty text has 64 zero bytes as its payload; equal texts have equal images, sizes and hashes; a very long text
is one image, as high as it needs, and no other text is held in memory beside it; a frequency at the median itself is a zero bit; rows
that repeat a doc_id, or each other, are stored each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalwright.llm._common import stored, text_slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, LOW = 32, 8


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    """The text with zeros up to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    kinds = np.empty((3, *rows.shape), dtype=np.uint8)
    kinds[0] = rows
    kinds[1] = rows
    kinds[1, :, 1:] -= rows[:, :-1]
    kinds[2] = rows
    kinds[2, 1:] -= rows[:-1]
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), dtype=np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk; an error where signature, length or checksum is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) != n or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, data
        at += 12 + n
    if kind != b"IEND":
        raise ValueError("the last chunk is missing")


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undoes the filters of 8-bit gray rows; rows of one kind that follow each other are undone at once where that is possible."""
    out = np.empty_like(lines)
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
        kind = kinds[lo]
        if kind == 0:
            out[lo:hi] = lines[lo:hi]
        elif kind == 1:
            np.add.accumulate(lines[lo:hi], axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind == 2:
            np.add.accumulate(lines[lo:hi], axis=0, dtype=np.uint8, out=out[lo:hi])
            if lo:
                out[lo:hi] += out[lo - 1]
        elif kind in (3, 4):
            for y in range(lo, hi):
                above = out[y - 1].tolist() if y else [0] * lines.shape[1]
                left = corner = 0
                for x, v in enumerate(lines[y].tolist()):
                    up = above[x]
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    left, corner = (v + guess) & 255, up
                    out[y, x] = left
        else:
            raise ValueError(f"filter {kind} is unknown")
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit gray image, as rows."""
    found = list(chunks(png))
    width, height, *form = struct.unpack(">IIBBBBB", found[0][1])
    if found[0][0] != b"IHDR" or form != [8, 0, 0, 0, 0]:
        raise ValueError("not an 8-bit gray image")
    raw = zlib.decompress(b"".join(data for kind, data in found if kind == b"IDAT"))
    if len(raw) != height * (width + 1):
        raise ValueError("the image has a wrong size")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, width + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _shares(n: int) -> np.ndarray:
    """A row for each of SIDE equal stretches: the mean over the samples in it, a sample at a border counting by its part."""
    edge = np.arange(SIDE + 1) * n / SIDE
    over = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
    return np.maximum(over, 0) * SIDE / n


_COSINES = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None])
_ACROSS = _shares(WIDTH).T @ _COSINES.T


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: the image's low frequencies above their median."""
    height, width = image.shape
    across = _ACROSS if width == WIDTH else _shares(width).T @ _COSINES.T
    narrow = image.astype(np.float64) @ across
    if height <= 512:
        down = _shares(height) @ narrow
    else:  # the same means through running sums: memory stays in proportion to the height
        total = np.concatenate([np.zeros((1, LOW)), np.cumsum(narrow, axis=0)])
        edge = np.arange(SIDE + 1) * height / SIDE
        low = np.minimum(edge.astype(np.int64), height - 1)
        at = total[low] + (edge - low)[:, None] * narrow[low]
        down = np.diff(at, axis=0) * SIDE / height
    low = np.round(_COSINES @ down, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


MEDIA = "doc_id long, n_bytes long, media binary"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the image of every text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            # slices are bounded by bytes, so that long texts don't stand in memory together with their images
            for own in text_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(own)], pa.array([len(x) for x in own], pa.int64()), pa.array([encode_png(payload_of(x)) for x in own], pa.binary())], ["doc_id", "n_bytes", "media"])
                at += len(own)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, MEDIA)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold: sizes, checksums and the hash of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for png in b.column(2):
                png = png.as_py()
                image = decode_png(png)
                raw = image.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image)))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                own = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own], [f.split()[0] for f in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def store_and_read(docs: DataFrame) -> DataFrame:
    """The images as a stored table with a binary column, and its features."""
    return features(stored(to_media(docs), "media", compression="uncompressed"))
