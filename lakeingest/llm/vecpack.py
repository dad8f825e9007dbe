"""Vector bin packing of token ids into sequences, by the dot-product heuristic.

A sequence has three limits at once: tokens, segments, and loss-bearing tokens. An open sequence takes, from
a pool of pieces, the piece that fits whole and whose demand has the largest dot product with what the
sequence has left (each in shares of its limit, so that scarce room is kept for those who need little of
it). If none fits whole, the piece with the largest product is cut to fill the sequence, and its rest stays
in the pool. Towards the end of a partition the capacity is the largest power of two that the rest of the
pool can fill, since such sequences need no padding.

Packing works within the partitions of the scan, without a shuffle; a task holds one pool of bounded size and
one batch of texts. Partitions of a scan are the same whenever they are read, so that a sequence id, made of
the partition's number and a count, is the same if a lost task runs again.

Defined results: a null or empty text is its end id alone; null and repeated doc_ids are documents of their
own; an empty table has no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import by_bytes, text_of
from lakeingest.llm.tokens import END, Encoder

TOKENS, SEGMENTS = 2048, 64
#: Pieces and ids that the pool of a task keeps back while more texts come.
POOL, POOL_IDS = 512, 2_000_000
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, loss_tokens bigint, n_segments bigint")


@dataclass
class Limits:
    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = TOKENS

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Piece:
    """Ids ``start`` to ``start + length`` of a document; ids from ``loss_from`` on bear loss."""

    doc_id: int | None
    ids: memoryview
    start: int
    length: int
    doc_tokens: int
    loss_from: int

    def loss(self, length: int | None = None) -> int:
        end = self.start + (self.length if length is None else length)
        return max(0, end - max(self.start, self.loss_from))

    def cut(self, length: int) -> tuple["Piece", "Piece | None"]:
        head = Piece(self.doc_id, self.ids[: 4 * length], self.start, length, self.doc_tokens, self.loss_from)
        if length == self.length:
            return head, None
        return head, Piece(self.doc_id, self.ids[4 * length :], self.start + length, self.length - length, self.doc_tokens, self.loss_from)

    def room(self, tokens: int, loss: int) -> int:
        """The most ids from the front within so many tokens and loss-bearing tokens."""
        return min(self.length, tokens, max(self.loss_from - self.start, 0) + loss)


class Packer:
    """Fills one sequence after the other from a pool of pieces."""

    def __init__(self, limits: Limits, pool: int = POOL):
        self.limits, self.pool = limits, pool
        self.pieces: list[Piece] = []
        self.lengths = np.zeros(0, np.int64)
        self.losses = np.zeros(0, np.int64)
        self.total = 0

    def add(self, pieces: list[Piece]) -> None:
        self.total += sum(p.length for p in pieces)
        self.pieces += pieces
        self.lengths = np.concatenate([self.lengths, [p.length for p in pieces]]).astype(np.int64)
        self.losses = np.concatenate([self.losses, [p.loss() for p in pieces]]).astype(np.int64)

    def _take(self, k: int) -> Piece:
        """Removes a piece by moving the last one to its place."""
        piece, last = self.pieces[k], self.pieces.pop()
        if k < len(self.pieces):
            self.pieces[k] = last
            self.lengths[k], self.losses[k] = self.lengths[-1], self.losses[-1]
        self.lengths, self.losses = self.lengths[:-1], self.losses[:-1]
        self.total -= piece.length
        return piece

    def sequence(self, capacity: int) -> list[Piece]:
        """The pieces of the next sequence, in order."""
        full, out = self.limits, []
        tokens, segments, loss = capacity, full.segments, full.loss
        while tokens and segments and self.pieces:
            gain = self.lengths * (tokens / full.tokens**2) + self.losses * (loss / full.loss**2)
            whole = (self.lengths <= tokens) & (self.losses <= loss)
            if segments == 1:  # the last segment fills what is left, if some piece can
                whole &= (self.lengths == tokens) | (self.lengths < tokens).all()
            if whole.any():
                piece = self._take(int(np.argmax(np.where(whole, gain, -1.0))))
            else:
                k = int(np.argmax(gain))
                length = self.pieces[k].room(tokens, loss)
                if length < 1:
                    fit = [i for i, p in enumerate(self.pieces) if p.room(tokens, loss) > 0]
                    if not fit:
                        break
                    k = fit[0]
                    length = self.pieces[k].room(tokens, loss)
                piece, rest = self._take(k).cut(length)
                if rest:
                    self.add([rest])
            out.append(piece)
            tokens, segments, loss = tokens - piece.length, segments - 1, loss - piece.loss()
        return out

    def drain(self, pieces: int, ids: int) -> Iterator[list[Piece]]:
        """Sequences, while the pool has more than so many pieces or ids."""
        while len(self.pieces) > pieces or self.total > ids:
            short = self.total < self.limits.tokens
            yield self.sequence(1 << (self.total.bit_length() - 1) if short else self.limits.tokens)


def pack(docs: DataFrame, tokenizer: str, kind: str, limits: Limits | None = None, loss_from: Column | None = None,
         end: int = END, pool: int = POOL) -> DataFrame:
    """A row per piece (``SCHEMA``). ``loss_from`` gives each document's first loss-bearing position (0 if left out)."""
    limits = limits or Limits()
    from_start = F.lit(0) if loss_from is None else F.coalesce(loss_from, F.lit(0))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), from_start.cast("bigint").alias("loss_from"), text_of().alias("text"))
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(limits, pool), Encoder.shared(tokenizer, kind)
        sequence_id = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence_id
            offset = 0
            for p in pieces:
                crc = zlib.crc32(p.ids)
                out.append((p.doc_id, p.start, p.length, crc, p.doc_tokens, sequence_id, offset, p.loss(), len(pieces)))
                offset += p.length
            sequence_id += 1

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

        for b in by_bytes(batches, "text"):
            for doc_id, first, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encode(b.column(2), end)):
                n = len(ids) // 4
                packer.add([Piece(doc_id, memoryview(ids), 0, n, n, first)])
                if len(packer.pieces) > 2 * pool or packer.total > 2 * POOL_IDS:
                    for pieces in packer.drain(pool, POOL_IDS):
                        emit(pieces)
            yield ready()
        for pieces in packer.drain(0, 0):
            emit(pieces)
        yield ready()

    return rows.mapInArrow(run, SCHEMA)
