"""Links between the tokens of two tokenizers over the same bytes, by products of sparse incidence matrices.

The matrices are in compressed rows (``CSR``). With A (tokens of the first tokenizer x bytes) and B (tokens of the second x
bytes), the row products of A and Bᵀ give the pairs of tokens that overlap, with the bytes they share. Bytes at which a
token of both ends cut the tokens into groups; the products of the incidence of tokens and groups give the pairs of tokens
that share a group. Products are computed row by row (Gustavson), vectorised over blocks of rows of bounded size.

Over a corpus, no token of either tokenizer reaches across a blank that stands between two other characters: such a blank
starts a new group. So a chunk of documents is aligned once per distinct stretch between blanks, and its distinct id pairs
are counted with how often their stretches occur. Texts with other white space are one stretch.

Shuffles: a row per chunk and distinct pair, twice; the chunks' positions, one compressed integer per stretch. A frequent
pair has one row per chunk. The chunks are a stored table, since encoding is the work here.

Defined results: null and empty texts, and texts whose joined token bytes differ from blank and text, have no tokens, groups
or links; null and repeated doc_ids are documents of their own, and repeated rows count as often as they occur; ties of
counts are all best; texts are never cut; an empty table gives no rows; extra columns are not read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeingest.llm.chunks import binary, content, in_chunks, pack_ints, unpack_ints
from lakeingest.llm.common import stored, text_of
from lakeingest.llm.tokens import Encoder, simple_words, worker_cache

#: Stretches, and distinct ones, of a chunk: an alignment holds much more per stretch than its text.
ITEMS, DISTINCT = 1_000_000, 100_000
#: Products of nonzeros that a block of rows may make (a single row may make more), and stretches aligned at once.
PRODUCTS, STRETCHES = 1 << 20, 20_000
#: Bytes of digest text that are laid out at once.
DIGEST_BYTES = 16 << 20
#: Words whose ids a worker keeps from one chunk to the next.
MEMO = 100_000


@dataclass
class CSR:
    """A sparse matrix of counts: row ``i`` has ``data`` in the columns ``indices``, from ``indptr[i]`` to ``indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @classmethod
    def of_stretches(cls, ends: np.ndarray, columns: int) -> "CSR":
        """Row ``i`` has ones from the end of row ``i - 1`` to its own end."""
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(columns), np.ones(columns, np.int64), columns)

    @classmethod
    def of_owners(cls, owners: np.ndarray, columns: int) -> "CSR":
        """Row ``i`` has a one in column ``owners[i]``."""
        return cls(np.arange(len(owners) + 1), owners, np.ones(len(owners), np.int64), columns)

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transposed(self) -> "CSR":
        row = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return CSR(indptr, row[order], self.data[order], self.rows)

    def work(self, other: "CSR") -> np.ndarray:
        """For every row, the number of products of nonzeros that its row of ``self x other`` takes."""
        size = np.concatenate([[0], np.cumsum(np.diff(other.indptr)[self.indices])])
        return size[self.indptr[1:]] - size[self.indptr[:-1]]

    def product(self, other: "CSR", most: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(rows, columns, values)`` of the nonzeros of ``self x other``, in blocks of rows."""
        done, start = np.concatenate([[0], np.cumsum(self.work(other))]), 0
        while start < self.rows:
            stop = max(start + 1, int(np.searchsorted(done, done[start] + most, "right")) - 1)
            yield self._rows_product(other, start, stop)
            start = stop

    def _rows_product(self, other: "CSR", start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.indptr[start], self.indptr[stop]
        middle = self.indices[a:b]
        row = np.repeat(np.arange(start, stop), np.diff(self.indptr[start : stop + 1]))
        size = other.indptr[middle + 1] - other.indptr[middle]
        # Every nonzero (i, k) scales row k of the other matrix into row i.
        at = np.arange(size.sum()) + np.repeat(other.indptr[middle] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        key = np.repeat(row, size) * other.columns + other.indices[at]
        value = np.repeat(self.data[a:b], size) * other.data[at]
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, value = key[first], np.add.reduceat(value, first) if len(first) else value
        return key // other.columns, key % other.columns, value


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts, dtype=np.int64)
    return total[ends] - total[ends - counts]


class Alignment:
    """Two sequences of tokens, each of which covers the same bytes; ``a`` and ``b`` are lengths of their tokens in bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.ends_a, self.ends_b = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
        n = int(self.ends_a[-1]) if len(a) else 0
        if n != (int(self.ends_b[-1]) if len(b) else 0):
            raise ValueError("the tokens cover different bytes")
        self.bytes_a, self.bytes_b = CSR.of_stretches(self.ends_a, n), CSR.of_stretches(self.ends_b, n)
        ends = np.zeros(n + 1, bool)
        ends[self.ends_a] = True
        both = np.zeros(n + 1, bool)
        both[self.ends_b] = ends[self.ends_b]
        before = np.cumsum(both) - both  # groups that end before a byte's end
        self.n_groups = int(both.sum())
        self.groups_a, self.groups_b = (CSR.of_owners(before[e], self.n_groups) for e in (self.ends_a, self.ends_b))

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Token pairs with the bytes they share: A x Bᵀ."""
        return self.bytes_a.product(self.bytes_b.transposed())

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Token pairs of the same group: the product of the incidence of tokens and groups."""
        return self.groups_a.product(self.groups_b.transposed())

    def ending_together(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The overlapping pairs whose bytes end at the same place, and how many tokens each token of A overlaps."""
        found_a, found_b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(self.bytes_a.rows, np.int64)
        for i, j, _ in self.overlaps():
            same = self.ends_a[i] == self.ends_b[j]
            found_a.append(i[same]), found_b.append(j[same])
            n += np.bincount(i, minlength=len(n))
        return np.concatenate(found_a), np.concatenate(found_b), n


class Tokenizers:
    """A byte-level BPE file (A) and a sentencepiece model (B) that adds the blank in front of a text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder = Encoder.shared(path_a, "space_led", True, MEMO)
        vocabulary = self.encoder.tokenizer.get_vocab()
        self.bytes_a = pa.array(_table({i: _byte_level(t) for t, i in vocabulary.items()}), pa.binary())
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = pa.array([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.binary())
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece goes on behind a blank
        self.lengths_a, self.lengths_b = (np.diff(content(t)[1], prepend=0) for t in (self.bytes_a, self.bytes_b))
        # Ids as digest text, by what follows them.
        self.digits = pa.array([b"%d%s" % (i, mark) for n, marks in ((len(self.bytes_a), b",|"), (len(self.bytes_b), b",;"))
                                for mark in (marks[:1], marks[1:]) for i in range(n)], pa.binary())

    @classmethod
    def shared(cls, path_a: str, path_b: str) -> "Tokenizers":
        """One per worker process."""
        kept = worker_cache()
        if ("align", path_a, path_b) not in kept:
            kept["align", path_a, path_b] = cls(path_a, path_b)
        return kept["align", path_a, path_b]

    def cut(self, text: str) -> list[str | bytes]:
        """Stretches behind blanks, or the whole text (as bytes) where a token might reach across."""
        return self.apart and simple_words(text) or [text.encode()]

    def encode(self, stretches: list[str | bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their counts per stretch, of A and of B; those whose bytes are not blank and stretch have none."""
        words = [x for x in stretches if isinstance(x, str)]
        texts = [x.decode() for x in stretches if not isinstance(x, str)]
        known, whole = iter(self.encoder.behind_blanks(words)), iter(self.encoder.direct([" " + t for t in texts]))
        a = [next(known) if isinstance(x, str) else next(whole) for x in stretches]
        plain = [x if isinstance(x, str) else x.decode() for x in stretches]
        b = self.model.encode(plain, num_threads=1)
        counts_a = np.fromiter((len(x) // 4 for x in a), np.int64, len(a))
        counts_b = np.fromiter(map(len, b), np.int64, len(b))
        ids_a = np.frombuffer(b"".join(a), "<u4").astype(np.int64)
        ids_b = np.fromiter((i for x in b for i in x), np.int64, int(counts_b.sum()))
        want = [b" " + x.encode() for x in plain]
        right = np.ones(len(plain), bool)
        for table, ids, counts in ((self.bytes_a, ids_a, counts_a), (self.bytes_b, ids_b, counts_b)):
            data, ends = content(table.take(pa.array(ids)))
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            if bytes(data) != b"".join(want) or not np.array_equal(np.diff(cuts), [len(x) for x in want]):
                right &= [data[s:e] == x for s, e, x in zip(cuts[:-1].tolist(), cuts[1:].tolist(), want)]
        if not right.all():
            ids_a, ids_b = ids_a[np.repeat(right, counts_a)], ids_b[np.repeat(right, counts_b)]
            counts_a, counts_b = counts_a * right, counts_b * right
        return ids_a, counts_a, ids_b, counts_b

    def digest_text(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment) -> pa.Array:
        """Per group, its ids as ``a1,a2|b1;`` (the separators of the whole included)."""
        group_a, group_b = found.groups_a.indices, found.groups_b.indices
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        per_a, per_b = (np.bincount(g, minlength=found.n_groups) for g in (group_a, group_b))
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[group_a]] = ids_a + len(self.bytes_a) * last_a
        codes[np.arange(len(ids_b)) + np.cumsum(per_a)[group_b]] = ids_b + 2 * len(self.bytes_a) + len(self.bytes_b) * last_b
        data, ends = content(self.digits.take(pa.array(codes)))
        return binary(data, np.concatenate([[0], ends])[np.cumsum(per_a + per_b)])


def _table(tokens: dict[int, bytes]) -> list[bytes]:
    return [tokens.get(i, b"") for i in range(1 + max(tokens, default=-1))]


def _byte_level(token: str) -> bytes:
    """The bytes of a byte-level entry: printable Latin-1 stands for itself, the other bytes in order for U+0100 onwards."""
    shown = _byte_level.shown
    return b"".join(shown[c] if c in shown else c.encode() for c in token)


def _shown() -> dict[str, bytes]:
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): bytes([b]) for b in printable} | {chr(256 + k): bytes([b]) for k, b in enumerate(others)}


_byte_level.shown = _shown()

_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")
_CHUNKS = ("chunk bigint, doc_ids array<bigint>, sizes array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in _COUNTS)
           + ", groups_sha256 array<string>, slots binary, links binary, codes binary, pairs binary, pair_counts binary")
_RESULT = ("doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", n_best bigint, count_sum bigint, groups_sha256 string")


def _digests(texts: list[pa.Array], slots: np.ndarray, sizes: np.ndarray) -> list[str]:
    """SHA-256 of every document's groups, laid out for some documents at a time; '' without groups."""
    table = pa.concat_arrays(texts) if texts else pa.array([], pa.binary())
    lengths = np.diff(content(table)[1], prepend=0)
    stops = np.cumsum(sizes)
    weight = np.concatenate([[0], np.cumsum(lengths[slots], dtype=np.int64)])[stops]
    out, start = [], 0
    while start < len(sizes):
        base = weight[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(weight, base + DIGEST_BYTES, "right")))
        first = stops[start - 1] if start else 0
        data, ends = content(table.take(pa.array(slots[first : stops[stop - 1]])))
        cuts = np.concatenate([[0], ends])[stops[start:stop] - first]
        at = 0
        for cut in cuts.tolist():
            out.append(hashlib.sha256(data[at : cut - 1]).hexdigest() if cut > at else "")
            at = cut
        start = stop
    return out


def _chunks(docs: DataFrame, path_a: str, path_b: str, items: int) -> DataFrame:
    """A row per chunk of documents: their results but the counts of pairs, positions, and the chunk's distinct pairs."""
    names = [f.split()[0] for f in _CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.shared(path_a, path_b)
        for c in in_chunks(batches, "text", both.cut, items, DISTINCT):
            per, keys, link_counts, texts = {k: [] for k in _COUNTS}, [], [], []
            for start in range(0, len(c.items), STRETCHES):
                ids_a, counts_a, ids_b, counts_b = both.encode(c.items[start : start + STRETCHES])
                found = Alignment(both.lengths_a[ids_a], both.lengths_b[ids_b])
                i, j, n_overlaps = found.ending_together()
                owner_a = np.repeat(np.arange(len(counts_a)), counts_a)
                links = np.bincount(owner_a[i], minlength=len(counts_a))
                group_owner = owner_a[np.flatnonzero(np.diff(found.groups_a.indices, prepend=-1))]
                groups = np.bincount(group_owner, minlength=len(counts_a))
                shared = _sums(found.groups_a.work(found.groups_b.transposed()), counts_a)
                overlaps = _sums(n_overlaps, counts_a)
                for k, v in zip(_COUNTS, (counts_a, counts_b, groups, links, overlaps, shared)):
                    per[k].append(v)
                keys.append(ids_a[i] << 32 | ids_b[j]), link_counts.append(links)
                texts.append(_joined(both.digest_text(ids_a, ids_b, found), groups))
            per = {k: np.concatenate(v or [np.zeros(0, np.int64)]) for k, v in per.items()}
            # A document of which one stretch has other bytes has no tokens at all.
            starts = np.concatenate([[0], np.cumsum(c.sizes)])
            wrong = np.concatenate([[0], np.cumsum(per["n_a"][c.slots] == 0)])
            good = wrong[starts[1:]] == wrong[starts[:-1]]
            slots, sizes = c.slots[np.repeat(good, c.sizes)], c.sizes * good
            pairs, codes = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_inverse=True)
            links = np.concatenate(link_counts or [np.zeros(0, np.int64)])
            times = np.repeat(np.bincount(slots, minlength=len(links)), links)
            n = np.bincount(codes, times, len(pairs)).astype(np.int64)
            lists = [sizes, *(_sums(per[k][slots], sizes) for k in _COUNTS)]
            columns = [pa.array([c.number]), pa.array([c.rows.column(0).to_pylist()], pa.list_(pa.int64())),
                       *(pa.array([x], pa.list_(pa.int64())) for x in lists), pa.array([_digests(texts, slots, sizes)], pa.list_(pa.string())),
                       *(pa.array([pack_ints(x)]) for x in (slots, links, codes)), pa.array([pairs.tobytes()]), pa.array([n.tobytes()])]
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(run, _CHUNKS)


def _joined(groups: pa.Array, counts: np.ndarray) -> pa.Array:
    """The texts of consecutive groups as one value per stretch."""
    data, ends = content(groups)
    return binary(data, np.concatenate([[0], ends])[np.cumsum(counts)])


def _pairs(chunks: DataFrame) -> DataFrame:
    """``(a, b, chunk, slot, n)``: the distinct pairs of every chunk and how many links have them."""
    names = ["a", "b", "chunk", "slot", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, pairs, counts in zip(*(b.column(k).to_pylist() for k in range(3))):
                pairs, counts = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64)
                for s in range(0, len(pairs), 50_000):
                    key = pairs[s : s + 50_000]
                    yield pa.record_batch([key >> 32, key & 0xFFFFFFFF, np.full(len(key), number), np.arange(s, s + len(key)), counts[s : s + 50_000]], names=names)

    return chunks.select("chunk", "pairs", "pair_counts").mapInArrow(run, "a bigint, b bigint, chunk bigint, slot bigint, n bigint")


def pair_counts(chunk_pairs: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: the links of every pair of ids, and whether no pair of the same ``b`` has more.

    An id ``b`` has at most as many pairs as there are ids ``a``.
    """
    counts = chunk_pairs.groupBy("a", "b").agg(F.sum("n").alias("count")).where("count > 0")
    return counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b")))


def _summed(chunks: pa.Table, found: pa.Table) -> pa.Table:
    """Per document of a chunk, the sums over its links."""
    row = chunks.to_pylist()[0]
    slots, links, codes = (unpack_ints(row[k]) for k in ("slots", "links", "codes"))
    values = np.zeros((2, row["n_pairs"]), np.int64)
    at = found.column("slot").to_numpy()
    values[0, at], values[1, at] = found.column("best").to_numpy().astype(np.int64), found.column("count").to_numpy()
    sums = [_sums(_sums(v[codes], links)[slots], np.array(row["sizes"], np.int64)) for v in values]
    columns = [pa.array(row["doc_ids"], pa.int64()), *(pa.array(row[k], pa.int64()) for k in _COUNTS), *map(pa.array, sums),
               pa.array(row["groups_sha256"], pa.string())]
    return pa.table(columns, names=[f.split()[0] for f in _RESULT.split(", ")])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))


def align(docs: DataFrame, path_a: str, path_b: str, items: int = ITEMS) -> DataFrame:
    """Per document: tokens, groups, links, the links whose pair is the best of its B id, and the sum of pair counts."""
    chunks, _ = stored(_chunks(_rows(docs), path_a, path_b, items), "align-chunks")
    pairs = _pairs(chunks)
    found = pairs.select("a", "b", "chunk", "slot").join(pair_counts(pairs), ["a", "b"]).select("chunk", "slot", "count", "best")
    whole = chunks.withColumn("n_pairs", F.expr("octet_length(pairs) div 8")).drop("pairs", "pair_counts")
    return whole.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_summed, _RESULT)


_LINKS = "doc_id bigint, kind string, a_index bigint, b_index bigint, a_id bigint, b_id bigint, weight bigint, ends_together boolean"


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every link of every document: ``overlap`` (weight: shared bytes) and ``group`` (weight 1), in blocks of bounded size."""
    names = [f.split()[0] for f in _LINKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.shared(path_a, path_b)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids_a, _, ids_b, _ = both.encode([text.encode()] if text else [])
                found = Alignment(both.lengths_a[ids_a], both.lengths_b[ids_b])
                for kind, blocks in (("overlap", found.overlaps()), ("group", found.shared_groups())):
                    for i, j, weight in blocks:
                        yield pa.record_batch([pa.array([doc_id] * len(i), pa.int64()), [kind] * len(i), i, j, ids_a[i], ids_b[j], weight,
                                               found.ends_a[i] == found.ends_b[j]], names=names)

    return _rows(docs).mapInArrow(run, _LINKS)
