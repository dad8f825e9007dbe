"""Byte-level BPE over a corpus: every distinct word is encoded once in the cluster; decoding by the token-byte table.

Encoding: texts are cut at blanks between other characters, and each distinct stretch of a chunk of documents into
pre-tokens by the vocabulary's pattern (which must not let a pre-token end in a blank of that kind or look back, as the
byte-level patterns do not). A chunk keeps its positions, and sends each of its distinct words as a row to the word's
partition. There, with the rows sorted, a word is encoded when it is
first met, and its ids join all its rows; rows go back to their chunks, where ids are put in place by position. Decoding
looks the ids up in the table of token bytes, which has one row per rank, at most ``MOST_TOKENS``, in every task.

Shuffles: one row per chunk and distinct word (twice, the second time with ids), and one compressed integer per
stretch. A word that holds a third of the corpus has one row per chunk. The texts are read and cut twice, which moves
less than keeping the positions and the words in one table would; both readings number documents by the partitions of the
scan, so ``docs`` should come from stored files, and a chunk whose two readings differ raises an error.

Defined results: null and empty texts have no ids; null and repeated doc_ids are documents of their own; repeated rows
and equal texts keep their rows; a text is never cut, however long (a chunk holds at least one document); an empty table
gives none; extra columns are not read, so their names cannot clash. There are no ties to settle. An id without bytes is an
error.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.chunks import ITEMS, Chunk, binary, content, in_chunks, pack_ints, unpack_ints
from lakeingest.llm.common import map_arrow, text_of
from lakeingest.llm.tokens import simple_words, worker_cache

#: The most ranks of a vocabulary; the table is held by every task.
MOST_TOKENS = 1 << 20
#: Rows that a task collects before it sends them back by chunk.
PACKED_ROWS = 500_000
#: Stretches that are cut into pre-tokens at once.
STRETCHES = 20_000

#: Blanks between other characters, for texts that have other white space as well.
_BLANK = regex.compile(r"(?<=\S) (?=\S)")

_POSITIONS = "chunk bigint, doc_ids array<bigint>, sizes array<bigint>, n_words bigint, slots binary, counts binary, places binary"
_WORDS = "word string, chunk bigint, slot bigint"
_PACKED = "chunk bigint, slots binary, sizes binary, ids binary"


class Ranks:
    """A rank file: base64 token and rank per line. ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if len(self.ranks) > MOST_TOKENS:
            raise ValueError(f"more than {MOST_TOKENS} ranks in {path}")
        self.split = regex.compile(pattern).findall
        self._encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        table: list[bytes | None] = [None] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            table[rank] = token
        self.table = pa.array(table, pa.binary())

    @classmethod
    def shared(cls, path: str, pattern: str) -> "Ranks":
        """One per worker process."""
        kept = worker_cache()
        if ("ranks", path, pattern) not in kept:
            kept["ranks", path, pattern] = cls(path, pattern)
        return kept["ranks", path, pattern]

    def word(self, word: str) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        return np.array(self._encoding._encode_single_piece(word), "<u4").tobytes()


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.record_batch(list(columns), names=[field.split()[0] for field in schema.split(", ")])


def _cut(text: str) -> list[str | bytes]:
    """Stretches that blanks between two other characters set apart, where no pre-token goes on and none looks across.

    The first stretch of a text comes as bytes. All others stand for themselves behind a blank.
    """
    parts = simple_words(text) or _BLANK.split(text)
    parts[0] = parts[0].encode()
    return parts


def _coded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, items: int) -> Iterator[tuple[Chunk, list[str], np.ndarray, np.ndarray]]:
    """Chunks of stretches; the distinct pre-tokens of each chunk, and per stretch their number and codes."""
    find = Ranks.shared(path, pattern).split
    for c in in_chunks(batches, "text", _cut, items):
        codes = defaultdict()
        codes.default_factory = codes.__len__
        counts, places = [], []
        for start in range(0, len(c.items), STRETCHES):
            found = [find(x.decode() if isinstance(x, bytes) else " " + x) for x in c.items[start : start + STRETCHES]]
            counts.append(np.fromiter(map(len, found), np.uint32, len(found)))
            places.append(np.fromiter(map(codes.__getitem__, chain.from_iterable(found)), np.uint32, int(counts[-1].sum())))
        found = None
        counts, places = (np.concatenate(x or [np.zeros(0, np.uint32)]) for x in (counts, places))
        c.items.clear()
        yield c, list(codes), counts, places


def _positions(docs: DataFrame, path: str, pattern: str, items: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, words, counts, places in _coded(batches, path, pattern, items):
            packed = [pa.array([pack_ints(x)]) for x in (c.slots, counts, places)]
            yield _batch(_POSITIONS, pa.array([c.number]), pa.array([c.rows.column(0).to_pylist()], pa.list_(pa.int64())),
                         pa.array([c.sizes], pa.list_(pa.int64())), pa.array([len(words)]), *packed)

    return docs.mapInArrow(run, _POSITIONS)


def _words(docs: DataFrame, path: str, pattern: str, items: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, words, _, _ in _coded(batches, path, pattern, items):
            for start in range(0, len(words), 50_000):
                part = words[start : start + 50_000]
                yield _batch(_WORDS, pa.array(part, pa.string()), pa.array(np.full(len(part), c.number)),
                             pa.array(np.arange(start, start + len(part))))

    return docs.mapInArrow(run, _WORDS)


def _pack(rows: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
    """One row per chunk: the slots, the number of ids of each, and the ids."""
    chunks, slots = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    order = np.argsort(chunks, kind="stable")
    data, ends = content(pa.concat_arrays([r[2] for r in rows]).take(pa.array(order)))
    chunks, slots, sizes = chunks[order], slots[order].astype("<u4"), np.diff(ends, prepend=0).astype("<u4") // 4
    cuts = np.flatnonzero(np.diff(chunks, prepend=chunks[0] - 1))
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chunks)]):
        ids = data[ends[a - 1] if a else 0 : ends[b - 1]]
        out.append((int(chunks[a]), pack_ints(slots[a:b]), pack_ints(sizes[a:b]), pack_ints(np.frombuffer(ids, "<u4"))))
    number, *rest = zip(*out)
    return _batch(_PACKED, pa.array(number, pa.int64()), *(pa.array(r, pa.binary()) for r in rest))


def _encoded_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of sorted words with their ids, by chunk. A word is encoded when it is first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, last, held, n = Ranks.shared(path, pattern), {}, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            ids = [last.get(w) or ranks.word(w) for w in distinct]
            last = {distinct[-1]: ids[-1]}  # rows are sorted, so only the last word can go on in the next batch
            held.append((b.column(1).to_numpy(), b.column(2).to_numpy(), pa.array(ids, pa.binary()).take(coded.indices)))
            n += b.num_rows
            if n >= PACKED_ROWS:
                yield _pack(held)
                held, n = [], 0
        if held:
            yield _pack(held)

    ordered = words.repartition("word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, _PACKED)


def _put_back(positions: pa.Table, packed: pa.Table) -> pa.Table:
    """The ids of every document of one chunk, in place."""
    names = ["doc_id", "ids"]
    if positions.num_rows != 1:
        raise RuntimeError("a chunk was read differently the second time; documents must come from stored files")
    row = positions.slice(0, 1).to_pylist()[0]
    doc_ids, sizes, n_words = pa.array(row["doc_ids"], pa.int64()), np.array(row["sizes"], np.int64), row["n_words"]
    slots, per_stretch, codes = (unpack_ints(row[name]) for name in ("slots", "counts", "places"))
    parts = [[unpack_ints(v) for v in r.values()] for r in packed.select(["slots", "sizes", "ids"]).to_pylist()]
    if sum(len(p[0]) for p in parts) != n_words:
        raise RuntimeError("a chunk was read differently the second time; documents must come from stored files")
    if not n_words:
        return pa.table([doc_ids, pa.array([b""] * len(sizes), pa.binary())], names=names)
    places, counts, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
    where = np.empty(n_words, np.int64)
    where[places] = np.arange(n_words)
    words = binary(ids.tobytes(), 4 * np.cumsum(counts, dtype=np.int64))
    data, ends = content(words.take(pa.array(where[codes])))  # of every distinct stretch, word by word
    stretches = binary(data, np.concatenate([[0], ends])[np.cumsum(per_stretch, dtype=np.int64)])
    data, ends = content(stretches.take(pa.array(slots)))
    stops = np.concatenate([[0], ends])[np.cumsum(sizes)]
    return pa.table([doc_ids, binary(data, stops)], names=names)


def encode(docs: DataFrame, path: str, pattern: str, items: int = ITEMS) -> DataFrame:
    """``(doc_id, ids)`` of every document: ids as little-endian unsigned 32-bit integers. ``path`` is on every node."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    places = _positions(rows, path, pattern, items).groupBy("chunk")
    encoded = _encoded_words(_words(rows, path, pattern, items), path, pattern).groupBy("chunk")
    return places.cogroup(encoded).applyInArrow(_put_back, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, data)``: the bytes that the ids stand for; no shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        table = Ranks.shared(path, pattern).table
        data, stops = content(b.column(1))
        ids = np.frombuffer(data, "<u4")
        if len(ids) and (ids.max() >= len(table) or pc.any(pc.is_null(table.take(pa.array(np.unique(ids)))).cast(pa.bool_())).as_py()):
            raise ValueError("an id has no bytes in the table")
        joined, ends = content(table.take(pa.array(ids)))
        return pa.record_batch([b.column(0), b.column(1), binary(joined, np.concatenate([[0], ends])[stops // 4])], names=["doc_id", "ids", "data"])

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return map_arrow(rows, run, "doc_id bigint, ids binary, data binary", "ids")
