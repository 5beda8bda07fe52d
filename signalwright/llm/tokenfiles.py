"""Token ids in sorted-string-table shards: documents keyed by identifier, found by binary search.

A file holds data blocks, an index block, a Bloom filter and a footer. In a block each key gives the number of leading bytes that it
shares with the key before it, and every 16th key is whole (a restart) so that a reader can search the restarts; a checksum ends the
block. The index has the last key, place and length of each block. Keys order as the identifiers do; a null identifier comes first.

Spark sorts the documents into range partitions of (doc_id, the text's first characters, a salt), so that rows of one repeated or missing
doc_id spread over many; each task streams its partition through the tokenizer into files in
the shared folder, one block in memory at a time. A file gets its name when whole, so that a task that runs again only replaces
it with the same bytes.

Defined results: a null text is an empty one and still gets its end id; a very long text is one entry, whole; rows that repeat a doc_id
are all kept, in the order of their texts' first `PREFIX` characters (beyond them in any order), and a lookup returns each that the file
holds; an empty table writes no files; other columns, whatever their names, are ignored. The string of a special token in a text is
ordinary text (`encode_special_tokens`, as the vocabularies' own description has it).
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalwright.llm._common import byte_encoder, cut, new_path, text_slices

MAGIC = b"SWTOKEN1"
FOOTER = struct.Struct("<QQQQQQQ8s")  # index at, length; filter at, length; documents; ids; bytes of an id; magic
RESTART = 16
#: Characters of a text that order the rows of one doc_id.
PREFIX = 64
MANIFEST = "path string, part long, roll long, docs long, ids long"


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
    return [(a + i * b) % bits for i in range(hashes)]


class TableWriter:
    """Writes ascending keys to an open file."""

    def __init__(self, out, width: int, block_bytes: int = 64 << 10, bits_per_key: int = 10):
        self.out, self.width, self.block_bytes, self.bits_per_key = out, width, block_bytes, bits_per_key
        self.at = self.docs = self.ids = 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.last, self.n = bytearray(), [], b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last, self.n = key, self.n + 1
        self.docs, self.ids = self.docs + 1, self.ids + len(ids) // self.width
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            raw += struct.pack("<I", zlib.crc32(raw))
            self.out.write(raw)
            self.index.append((self.last, self.at, len(raw)))
            self.at += len(raw)
        self._start()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits, hashes = max(64, len(self.keys) * self.bits_per_key), 7
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits, hashes):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = struct.pack("<QI", bits, hashes) + bytes(bloom)
        self.out.write(index + tail + FOOTER.pack(self.at, len(index), self.at + len(index), len(tail), self.docs, self.ids, self.width, MAGIC))


class TableReader:
    """Reads a file by its footer: all documents block by block, or one identifier."""

    def __init__(self, file, size: int):
        self.file = file
        index_at, index_n, bloom_at, bloom_n, self.docs, self.ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        raw, at = self._read(index_at, index_n), 0
        self.lasts: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.lasts.append(raw[at : at + n])
            place, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.blocks.append((place, length))
        bloom = self._read(bloom_at, bloom_n)
        self.bits, self.hashes = struct.unpack_from("<QI", bloom)
        self.bloom = bloom[12:]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        raw = self._read(*self.blocks[k])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        (n,) = struct.unpack_from("<I", raw, len(raw) - 8)
        at = len(raw) - 8 - 4 * n
        return raw[:at], list(struct.unpack_from(f"<{n}I", raw, at))

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.blocks)):
            for key, ids in self._entries(self._block(k)[0], 0):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of each document of this identifier: filter, then index, then restarts."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits, self.hashes)):
            return []
        found = []
        for k in range(bisect_left(self.lasts, key), len(self.blocks)):
            raw, restarts = self._block(k)
            firsts = [next(self._entries(raw, r))[0] for r in restarts]
            for own, ids in self._entries(raw, restarts[max(0, bisect_left(firsts, key) - 1)]):
                if own == key:
                    found.append(ids)
                elif own > key:
                    return found
        return found


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    return pyarrow.fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (pyarrow.fs.LocalFileSystem(), path)


def write_tables(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes all documents in ascending doc_id order; one row for each file, in `part`, `roll` order (path, docs, ids)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = byte_encoder(tokenizer).encode, int(end_id).to_bytes(2, "little")
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done: list[tuple] = []
        out = table = None

        def finish() -> None:
            table.close()
            out.close()
            name = f"{root}/part-{part:06d}-{len(done):03d}.sst"
            fs.move(f"{root}/.{attempt}-{len(done)}", name)
            done.append((f"{folder}/part-{part:06d}-{len(done):03d}.sst", part, len(done), table.docs, table.ids))

        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in text_slices(batch.column(1)):
                for raw in encode(texts):
                    if table is None:
                        out = fs.open_output_stream(f"{root}/.{attempt}-{len(done)}")
                        table = TableWriter(out, 2)
                    table.add(key_of(ids[at].as_py()), raw + tail)
                    at += 1
                    if table.at >= file_bytes:
                        finish()
                        table = None
        if table is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "part", "roll", "docs", "ids"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = F.col("doc_id").asc_nulls_first()
    # a prefix, since the bounds of the ranges are collected; the salt spreads rows that are alike
    ordered = narrow.repartitionByRange(n, first, F.substring("text", 1, PREFIX), F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(first, "text")
    return cut(ordered.mapInArrow(write, MANIFEST))


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: start counts the ids of all documents before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, own = _open(path)
                with fs.open_input_file(own) as file:
                    rows: list[tuple] = []
                    for doc_id, raw in TableReader(file, file.size()):
                        ids = np.frombuffer(raw, dtype="<u2")
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    based = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return based.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' token files in the shared folder and reads them back."""
    return read_tables(write_tables(docs, tokenizer, new_path(docs.sparkSession, "tokens"), end_id))


def in_memory(rows: list[tuple[int | None, bytes]], width: int = 2, block_bytes: int = 64 << 10) -> TableReader:
    """A table of the given ascending rows, held in memory."""
    out = io.BytesIO()
    table = TableWriter(out, width, block_bytes)
    for doc_id, ids in rows:
        table.add(key_of(doc_id), ids)
    table.close()
    return TableReader(out, out.tell())
