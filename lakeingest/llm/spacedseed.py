"""Benchmark decontamination by spaced seeds.

Words of test items and documents are hashed under fixed masks that look at six of up to eleven positions,
so that substitutions at the ignored positions do no harm. Where a document's hash meets an item's, the two
are laid over each other at that place, and the overlap counts if some stretch of ``STRETCH`` aligned words
(the whole item, if it is shorter) agrees in ``AGREE`` or more of its words. With these masks every such
stretch holds a hit. Items shorter than a stretch are hashed by runs of so many words that one of them must be
whole; one of fewer than ``LEAST`` words says too little and meets only a document that is just these words.

Items become a table of seeds. Documents are hashed where they lie; a bit filter of the items' seeds, at most
``FILTER_WORDS`` words of 64 bits, lets few of their hashes on, and these meet the seeds in a join. The hits of a text
with an item are gathered as the distinct places where the item may lie, at most one per word of both. With the item's
words they are joined to the documents by a hash of 128 bits of the text, and every place is verified there. Equal
texts share their hits. Nothing of the benchmark passes the driver but the filter and the lengths of runs; joins carry
no hints, so the smaller side is sent out only by its measured size and hot seeds or texts are split at run time.

Words are runs of bytes other than white space and ASCII punctuation, with A-Z in lower case.

Defined results: null and empty texts and items without a word meet nothing; repeated rows and repeated
items each give their own rows; of several places of a pair the one with most agreeing words counts, then the longest,
then the first; texts are hashed whole, however long; an empty benchmark leaves every document as it is; other columns
are kept by ``clean`` whatever their names, and not read by ``overlaps``.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import PIECE_BYTES, by_bytes, stored, text_of

#: Positions that a mask looks at.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 6, 9), (0, 1, 3, 8, 9, 10), (0, 3, 4, 6, 8, 10))
STRETCH, AGREE, LEAST = 13, 0.8, 8
#: Words of 64 bits of the filter: about one for two seeds, and no more than this (16 MB).
FILTER_WORDS = 1 << 21
_FACTORS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)]
_PLAIN = bytes.maketrans(string.punctuation.encode() + bytes(range(65, 91)), b" " * len(string.punctuation) + bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _codes(found: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def _seeds(codes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash of every placement of a mask."""
    n = max(len(codes) - mask[-1], 0)
    mix = np.full(n, (salt * _FACTORS[3]) % (1 << 64), np.uint64)
    for k, at in enumerate(mask):
        mix += codes[at : at + n] * np.uint64(_FACTORS[k % 16])
        mix ^= mix >> np.uint64(29)
    return mix


def _run(n: int) -> int:
    """Words of the runs of an item of ``n`` words: with the substitutions allowed, one run stays whole. 0: masks serve."""
    if not 0 < n < STRETCH:
        return 0
    return n if n < LEAST else n // (n - int(np.ceil(AGREE * n)) + 1)


def agreeing(text: np.ndarray, item: np.ndarray, first: int) -> tuple[int, int, int] | None:
    """First word, words and agreeing words of the overlap with the item's start laid at ``first``."""
    low, high = max(first, 0), min(first + len(item), len(text))
    need = min(STRETCH, len(item))
    if not need or high - low < need or len(item) < LEAST and len(text) != len(item):
        return None
    same = text[low:high] == item[low - first : high - first]
    sums = np.concatenate([[0], np.cumsum(same)])
    if (sums[need:] - sums[:-need]).max() < np.ceil(AGREE * need):
        return None
    return low, high - low, int(same.sum())


def _kinds(runs: Iterable[int]) -> list[tuple[tuple[int, ...], int]]:
    """Masks and runs, each with the number that tells its hashes apart."""
    return [(m, k) for k, m in enumerate(MASKS)] + [(tuple(range(n)), 100 + n) for n in runs]


def item_words(benchmark: DataFrame) -> DataFrame:
    """``(ik, item_id, codes, run)`` of every item with a word: its number, its words' hashes and its run length."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("ik"), F.col("item_id").cast("string").alias("item_id"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            codes = [_codes(words(t)) for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([_run(len(c)) for c in codes], pa.int32())]
            yield pa.record_batch(columns, names=["ik", "item_id", "codes", "run"])

    return rows.mapInArrow(run, "ik bigint, item_id string, codes binary, run int").where(F.octet_length("codes") > 0)


def item_seeds(items: DataFrame) -> DataFrame:
    """``(seed, ik, place)`` of all placements of the masks, or of the item's run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "codes", PIECE_BYTES // 8):
            seeds, keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for ik, data, length in zip(*(b.column(k).to_pylist() for k in range(3))):
                for mask, salt in _kinds([length])[len(MASKS) :] if length else _kinds([]):
                    got = _seeds(np.frombuffer(data, np.uint64), mask, salt)
                    seeds.append(got), keys.append(np.full(len(got), ik)), places.append(np.arange(len(got)))
            columns = [np.concatenate(seeds).view(np.int64), np.concatenate(keys), np.concatenate(places)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["seed", "ik", "place"])

    return items.select("ik", "codes", "run").mapInArrow(run, "seed bigint, ik bigint, place bigint")


class Sieve:
    """A filter that every seed of the items passes: two bits in one of its words."""

    def __init__(self, seeds: DataFrame, most: int = FILTER_WORDS):
        n = min(most, 1 << max(6, (seeds.count() // 2).bit_length()))
        self.shift = 64 - n.bit_length() + 1
        bits = F.expr("shiftleft(1L, cast(seed & 63 AS int)) | shiftleft(1L, cast((seed >> 6) & 63 AS int))")
        held = seeds.groupBy(F.shiftrightunsigned("seed", self.shift).alias("at")).agg(F.bit_or(bits).alias("bits"))
        found = held.toArrow()  # one row per word of the filter
        self.bits = np.zeros(n, np.uint64)
        self.bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def passing(self, seeds: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        asked = (one << (seeds & low)) | (one << ((seeds >> np.uint64(6)) & low))
        return np.flatnonzero(self.bits[(seeds >> np.uint64(self.shift)).astype(np.int64)] & asked == asked)


def _hashed() -> list[Column]:
    return [F.xxhash64(text_of()).alias("t1"), F.xxhash64(text_of(), F.lit(1)).alias("t2")]


def document_seeds(docs: DataFrame, sieve: Sieve, runs: list[int]) -> DataFrame:
    """``(seed, t1, t2, at)`` of the documents' hashes that pass the sieve."""
    sent, kinds = docs.sparkSession.sparkContext.broadcast(sieve), _kinds(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sent.value
        for b in by_bytes(batches, "text"):
            split = [words(t) for t in b.column(2).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
            codes = _codes(list(chain.from_iterable(split)))
            one, two = (b.column(k).to_numpy() for k in range(2))
            for mask, salt in kinds:
                mix = _seeds(codes, mask, salt)
                at = sieve.passing(mix)
                doc = np.searchsorted(starts, at, "right") - 1
                inside = at + mask[-1] < starts[doc + 1]  # no placement over the end of a text
                at, doc = at[inside], doc[inside]
                columns = [mix[at].view(np.int64), one[doc], two[doc], at - starts[doc]]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["seed", "t1", "t2", "at"])

    return docs.select(*_hashed(), text_of().alias("text")).mapInArrow(run, "seed bigint, t1 bigint, t2 bigint, at bigint")


def _verified(docs: DataFrame, benchmark: DataFrame, filter_words: int) -> DataFrame:
    """``(t1, t2, doc_id, item_id, first_word, n_words, n_agree)`` of every row of ``docs`` and item that overlap."""
    items, _ = stored(item_words(benchmark), "seed-items")
    seeds, _ = stored(item_seeds(items), "seed-places")
    runs = sorted(r[0] for r in items.where("run > 0").select("run").distinct().collect())  # below STRETCH each
    met = document_seeds(docs, Sieve(seeds, filter_words), runs).join(seeds, "seed")
    places = met.groupBy("t1", "t2", "ik").agg(F.collect_set(F.col("at") - F.col("place")).alias("firsts"))
    hits, _ = stored(places.join(items.drop("run"), "ik").drop("ik"), "seed-hits")
    rows = docs.select(*_hashed(), F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text = None, np.zeros(0, np.uint64)
        for b in by_bytes(batches, "text"):
            kept, best = [], []
            for i in range(b.num_rows):
                key = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if key != last:
                    last, text = key, _codes(words(b.column(3)[i].as_py()))
                item = np.frombuffer(b.column(5)[i].as_py(), np.uint64)
                found = [got for first in b.column(6)[i].as_py() if (got := agreeing(text, item, first))]
                if found:
                    kept.append(i)
                    best.append(max(found, key=lambda g: (g[2], g[1], -g[0])))
            taken = [b.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1, 2, 4)]
            columns = taken + [pa.array([g[k] for g in best], pa.int64()) for k in range(3)]
            yield pa.record_batch(columns, names=["t1", "t2", "doc_id", "item_id", "first_word", "n_words", "n_agree"])

    joined = rows.join(hits, ["t1", "t2"]).select("t1", "t2", "doc_id", "text", "item_id", "codes", "firsts")
    return joined.mapInArrow(run, "t1 bigint, t2 bigint, doc_id bigint, item_id string, first_word bigint, n_words bigint, n_agree bigint")


def overlaps(docs: DataFrame, benchmark: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """``(doc_id, item_id, first_word, n_words, n_agree)``: a row per document and item that overlap."""
    return _verified(docs, benchmark, filter_words).drop("t1", "t2")


def clean(docs: DataFrame, benchmark: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, all columns as they are."""
    texts = docs.select(F.lit(0).alias("doc_id"), "text")
    free = "met"
    while free in (name.lower() for name in docs.columns):
        free += "_"
    met = _verified(texts, benchmark, filter_words).select(F.struct("t1", "t2").alias(free)).distinct()
    return docs.join(stored(met, "seed-met")[0], F.struct(*_hashed()) == F.col(free), "left_anti")
