"""Token-id output: blocks of ids turned into bit or byte planes, each plane compressed, with a chunk index.

A file holds one range of documents. Layout, little-endian throughout::

    magic "IDPLANE1"
    chunks   per block: the compressed planes, lowest first; a plane of zeros takes no bytes
    index    zstd of: per block, id count and the byte length of each plane
    documents  zstd of: doc ids (int64), flags of null doc ids (uint8), id counts (int64)
    trailer  <QQQQHBB>: start of index, start of documents, documents, ids, block size / 256,
             planes in a chunk, bits of a plane (1 or 8)

Files are written by the tasks that tokenise, under a name of their own per attempt; the manifest that
Spark commits names the files that count, so retried and speculative tasks do no harm.

Defined results: a null or empty text has the end id alone; a null doc_id sorts first and stays null;
rows with equal doc_ids follow each other by text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeingest.llm.common import by_bytes, stored, text_of
from lakeingest.llm.tokens import END, Encoder
from lakeingest.session import work_folder
from lakeingest.sources.remote import open_input, resolve

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
LEVEL = 3
_TRAILER = "<QQQQHBB"
_MANIFEST = "path string, first_null boolean, first_id bigint, first_text string, n_docs bigint, n_ids bigint, n_bytes bigint"


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Planes of unsigned 32-bit ids: 32 of one bit each, or 4 of one byte each; lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int, bits: int) -> np.ndarray:
    """The inverse; ``None`` stands for a plane of zeros."""
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if plane is None:
            continue
        data = np.frombuffer(plane, np.uint8)
        if bits == 8:
            raw[:, k] = data
        else:
            raw[:, k // 8] |= np.unpackbits(data, count=n, bitorder="little") << np.uint8(k % 8)
    return raw.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; holds at most a block of ids beyond what is appended."""

    def __init__(self, out, bits: int = 8, block: int = BLOCK_IDS):
        import zstandard

        if bits not in (1, 8) or block % 256:
            raise ValueError("planes have 1 or 8 bits, and blocks a multiple of 256 ids")
        self.out, self.bits, self.block = out, bits, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0
        self.index: list[int] = []
        self.docs: tuple[list[int], list[bool], list[int]] = ([], [], [])
        self.at = len(MAGIC)
        out.write(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def append(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs[0].append(doc_id or 0), self.docs[1].append(doc_id is None), self.docs[2].append(n)
        self.held.append(ids)
        self.n_held += n
        self.n_ids += n
        if self.n_held >= self.block:
            data, size = b"".join(self.held), 4 * self.block
            whole = len(data) // size * size
            for i in range(0, whole, size):
                self._chunk(data[i : i + size])
            self.held, self.n_held = [data[whole:]], (len(data) - whole) // 4

    def _chunk(self, data: bytes) -> None:
        self.index.append(len(data) // 4)
        for plane in to_planes(np.frombuffer(data, "<u4"), self.bits):
            self.index.append(self._put(self.pack(plane)) if plane.strip(b"\0") else 0)

    def close(self) -> int:
        """Writes index, documents and trailer; the file's bytes."""
        if self.n_held:
            self._chunk(b"".join(self.held))
        index_at = self.at
        self._put(self.pack(np.array(self.index, "<i8").tobytes()))
        docs_at = self.at
        ids, nulls, counts = self.docs
        parts = np.array(ids, "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(), np.array(counts, "<i8").tobytes()
        self._put(self.pack(b"".join(parts)))
        self._put(struct.pack(_TRAILER, index_at, docs_at, len(ids), self.n_ids, self.block // 256, 32 // self.bits, self.bits))
        return self.at


class PlaneReader:
    """Reads a file by its index, a chunk at a time."""

    def __init__(self, file):
        import zstandard

        self.file = file
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = file.size()
        if size < len(MAGIC) + struct.calcsize(_TRAILER) or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of id planes")
        end = size - struct.calcsize(_TRAILER)
        index_at, docs_at, self.n_docs, self.n_ids, block, self.planes, self.bits = struct.unpack(_TRAILER, self._at(end, struct.calcsize(_TRAILER)))
        self.block = 256 * block
        table = np.frombuffer(self.unpack(self._at(index_at, docs_at - index_at)), "<i8").reshape(-1, 1 + self.planes)
        self.counts, self.sizes = table[:, 0], table[:, 1:]
        self.starts = len(MAGIC) + np.concatenate([[0], np.cumsum(self.sizes.sum(1))]).astype(np.int64)
        data = self.unpack(self._at(docs_at, end - docs_at))
        n = self.n_docs
        self.doc_ids = np.frombuffer(data, "<i8", n)
        self.null_ids = np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
        self.doc_counts = np.frombuffer(data, "<i8", n, 9 * n)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(int(start))
        return self.file.read(int(size))

    def chunk(self, k: int) -> np.ndarray:
        """The ids of block ``k``; only its bytes are read."""
        data, at, planes = self._at(self.starts[k], self.starts[k + 1] - self.starts[k]), 0, []
        for size in self.sizes[k].tolist():
            planes.append(self.unpack(data[at : at + size]) if size else None)
            at += size
        return from_planes(planes, int(self.counts[k]), self.bits)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``, from the chunks that hold them."""
        first, last = start // self.block, (start + max(n, 1) - 1) // self.block
        if not n:
            return np.zeros(0, "<u4")
        got = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return got[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Per document: id, start in the file, id count, crc32 of its ids; one chunk in memory at a time."""
        k, chunk, used, start = 0, b"", 0, 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.null_ids.tolist(), self.doc_counts.tolist()):
            left, crc = 4 * n, 0
            while left:
                if used == len(chunk):
                    chunk, used, k = self.chunk(k).tobytes(), 0, k + 1
                part = chunk[used : used + left]
                crc = zlib.crc32(part, crc)
                used += len(part)
                left -= len(part)
            yield None if null else doc_id, start, n, crc
            start += n


def write(docs: DataFrame, tokenizer: str, kind: str, folder: str | None = None, bits: int = 8,
          block: int = BLOCK_IDS, end: int = END) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the manifest, a row per file.

    One shuffle, by ranges of doc_id. ``tokenizer`` is the path of a tokenizer file on every node.
    """
    folder = folder or work_folder(docs.sparkSession, "id-planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = first = None
        path = f"{folder}/{uuid.uuid4().hex}.planes"
        encode = Encoder.shared(tokenizer, kind)
        for b in by_bytes(batches, "text"):
            texts = b.column(1).to_pylist()
            if writer is None:
                fs, name = resolve(path)
                fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(name)
                writer, first = PlaneWriter(out, bits, block), (b.column(0)[0].as_py(), texts[0])
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(texts, end)):
                writer.append(doc_id, ids)
        if writer is not None:
            size = writer.close()
            out.close()
            rows = [[path], [first[0] is None], [first[0]], [first[1]], [len(writer.docs[0])], [writer.n_ids], [size]]
            kinds = pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, kinds)], names=[f.split()[0] for f in _MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest, _ = stored(ordered.mapInArrow(run, _MANIFEST), "id-manifest")
    # A row per file: ranges of doc_id do not overlap, so the first rows of the files order them.
    before = W.orderBy(F.desc("first_null"), "first_id", "first_text").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("first_text")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all files, n_tokens, ids_crc32. A task per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_input(path) as file:
                    rows = list(PlaneReader(file).documents())
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                columns[1] = pa.compute.add(columns[1], start)
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    files = manifest.select("path", "start").repartition(4 * n, "path")
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
