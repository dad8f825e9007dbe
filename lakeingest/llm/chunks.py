"""Items of documents in chunks: consecutive documents of a task, coded by the distinct items of the chunk.

Corpus-wide work on items (words, pairs of ids) then moves one row per chunk and *distinct* item instead of one
per occurrence; a common item has no more rows than there are chunks. The positions of a chunk stay one column
of small integers, and what the distinct items turned into is put back by position.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from lakeingest.llm.common import by_bytes

#: A chunk is closed after the document with which it has so many items, or so many distinct ones.
ITEMS, DISTINCT = 4_000_000, 400_000
#: Bytes of texts that are cut at once.
PIECE_BYTES = 1 << 20


@dataclass
class Chunk:
    """``slots`` has, for every item in order, its place in ``items``; ``sizes`` the number of items of every document."""

    number: int
    rows: pa.RecordBatch
    sizes: np.ndarray
    slots: np.ndarray
    items: list


def in_chunks(batches: Iterator[pa.RecordBatch], column: str, split: Callable[[str], list], items: int = ITEMS,
              distinct: int = DISTINCT) -> Iterator[Chunk]:
    """The documents of a task in chunks; a null text has no items. ``rows`` holds the other columns.

    A chunk's number is made of the partition's number and a count. Partitions of a scan are the same whenever they
    are read, so chunks are the same if a lost task runs again.
    """
    number = TaskContext.get().partitionId() << 32
    codes = defaultdict()
    codes.default_factory = codes.__len__
    rows, sizes, slots = [], [], []
    n = 0

    def close() -> Chunk:
        nonlocal number, n
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches() or rows[:1]
        out = Chunk(number, whole[0], np.concatenate(sizes), np.concatenate(slots), list(codes))
        number, n = number + 1, 0
        codes.clear(), rows.clear(), sizes.clear(), slots.clear()
        pa.default_memory_pool().release_unused()
        return out

    for batch in by_bytes(batches, column, PIECE_BYTES):
        found = [split(t) if t else [] for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        total = int(counts.sum())
        slots.append(np.fromiter(map(codes.__getitem__, chain.from_iterable(found)), np.uint32, total))
        sizes.append(counts)
        rows.append(batch.drop_columns([column]))
        del found
        n += total
        if n >= items or len(codes) >= distinct:
            yield close()
    if rows:
        yield close()


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as their four byte planes, each compressed: small values take little room."""
    import zstandard

    pack = zstandard.ZstdCompressor(1).compress
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    planes = [pack(np.ascontiguousarray(raw[:, k]).tobytes()) if raw[:, k].any() else b"" for k in range(4)]
    return struct.pack("<Q4I", len(raw), *map(len, planes)) + b"".join(planes)


def unpack_ints(data: bytes) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    n, *sizes = struct.unpack_from("<Q4I", data)
    out, at = np.zeros((n, 4), np.uint8), struct.calcsize("<Q4I")
    for k, size in enumerate(sizes):
        if size:
            out[:, k] = np.frombuffer(unpack(data[at : at + size]), np.uint8)
            at += size
    return out.reshape(-1).view("<u4")


def binary(data, ends: np.ndarray) -> pa.Array:
    """A binary array over one buffer, cut behind each of ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def content(array: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The joined bytes of a binary array, and the end of every value in them."""
    _, offsets, data = array.buffers()
    cuts = np.frombuffer(offsets, np.int32, len(array) + 1, 4 * array.offset) if len(array) else np.zeros(1, np.int32)
    return memoryview(data if data is not None else b"").cast("B")[cuts[0] : cuts[-1]], cuts[1:].astype(np.int64) - cuts[0]
