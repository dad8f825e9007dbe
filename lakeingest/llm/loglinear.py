"""Scoring by a log-bilinear language model, trained with noise-contrastive estimation.

Classes are the most frequent training words, one bucket each for the other words by their last two bytes,
and the end of a text. The model predicts a token's class from the two classes before it: their vectors,
through one matrix per position, sum to a query whose products with all class vectors are scores. A word of
a bucket then has its smoothed share of the bucket's training tokens, so that token probabilities, with one
share per bucket for words never seen, sum to one.

Counts and training cover all training texts. Every partition of the scan trains on its own texts, in numpy
with noise words shared by a batch, and the results are averaged by token count, in ``rounds`` rounds. What
goes out to tasks is bounded: the parameters, the table of normalisers of all pairs of classes (from batched
matrix products) and the counts of at most ``LISTED`` frequent words. The other words of each text meet
their counts in a join, aggregated per text, so that no frequent word is a key of it.

Defined results: a null or empty text is its end alone; null and repeated doc_ids are scored row by row;
with no training text every count is zero and the model is uniform; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import by_bytes, frequent, stored, text_of

#: Words with a class of their own, buckets of the others, size of vectors, noise words of a batch.
WORDS, BUCKETS, DIM, NOISE, BATCH = 447, 64, 24, 32, 4096
RATE, ROUNDS = 0.05, 2
#: Most frequent words whose counts go out to tasks, and distinct words that a task counts before it sends them on.
LISTED, HELD = 100_000, 250_000
SMOOTH = 0.1
FOLDS = 10


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def held_out(doc_id: Column) -> Column:
    """Every tenth document by the hash of its id as text; a null id hashes like the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts, combined in tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
            return pa.record_batch(columns, names=["word", "c"])

        for b in by_bytes(batches, "text"):
            for t in b.column(0).to_pylist():
                held.update(tokens(t))
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        yield sent()

    return docs.select(text_of().alias("text")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Parameters:
    """Class vectors, a matrix per context position, and biases."""

    vectors: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.vectors.ravel(), self.near.ravel(), self.far.ravel(), self.bias])

    @classmethod
    def of(cls, flat: np.ndarray, dim: int = DIM) -> "Parameters":
        flat = flat.astype(np.float32)
        n = (len(flat) - 2 * dim * dim) // (dim + 1)
        a, b, c = n * dim, n * dim + dim * dim, n * dim + 2 * dim * dim
        return cls(flat[:a].reshape(n, dim), flat[a:b].reshape(dim, dim), flat[b:c].reshape(dim, dim), flat[c:])

    @classmethod
    def start(cls, share: np.ndarray, dim: int = DIM, seed: int = 5) -> "Parameters":
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.3, (len(share), dim))
        return cls.of(np.concatenate([vectors.ravel(), 0.3 * np.eye(dim).ravel(), 0.2 * np.eye(dim).ravel(), np.log(share)]), dim)

    def log10_table(self) -> np.ndarray:
        """log10 of the normaliser of every pair (class before, class before that)."""
        n = len(self.bias)
        near, far = (self.vectors @ m @ self.vectors.T for m in (self.near, self.far))
        out = np.empty((n, n))
        for c in range(n):
            scores = (near[c] + self.bias + far).astype(np.float64)
            top = scores.max(1)
            out[c] = (top + np.log(np.exp(scores - top[:, None]).sum(1))) / np.log(10)
        return out


def by_class(classes: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sums of the rows of every class."""
    order = np.argsort(classes.astype(np.uint16), kind="stable")  # a radix sort; ``Classes`` are fewer than 65 536
    found = classes[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[found[first]] = np.add.reduceat(rows.take(order, 0), first, axis=0)
    return out


class Trainer:
    """Ascent on the noise-contrastive objective with per-parameter rates (sums of squared gradients)."""

    def __init__(self, start: np.ndarray, share: np.ndarray, dim: int = DIM, seed: int = 11):
        self.flat, self.share, self.dim = start.astype(np.float32).copy(), share, dim
        self.cumulated, self.rng = np.cumsum(share), np.random.default_rng(seed)
        self.offset = np.log(NOISE * share).astype(np.float32)
        self.squares = np.full(len(self.flat), 1e-6, np.float32)
        self.n = 0

    def step(self, word: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        p, n, size = Parameters.of(self.flat, self.dim), len(word), len(self.share)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), size - 1)
        # Biases are a last column of the vectors and meet a one in the queries, so that products and sums take them along.
        biased = np.column_stack([p.vectors, p.bias - self.offset])
        v_word, v_noise = biased.take(word, 0), biased[noise]
        # Classes are few: matrices meet the class vectors, not the vector of every token.
        one, zero = np.ones((size, 1), np.float32), np.zeros((size, 1), np.float32)
        query = np.hstack([p.vectors @ p.near, one]).take(near, 0)
        query += np.hstack([p.vectors @ p.far, zero]).take(far, 0)
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", query, v_word), -30, 30)))
        # A number per token and noise word: the steps to -1 / (1 + exp(-x)) reuse its memory.
        down = query @ v_noise.T
        np.clip(down, -30, 30, out=down)
        np.exp(np.negative(down, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        pull = down @ v_noise
        v_word *= up[:, None]
        pull += v_word
        at_noise = down.T @ query
        query *= up[:, None]
        at_near, at_far = (by_class(c, pull, size)[:, :-1] for c in (near, far))
        at_word = by_class(word, query, size)
        np.add.at(at_word, noise, at_noise)
        vectors = at_word[:, :-1] + at_near @ p.near.T + at_far @ p.far.T
        grad = np.concatenate([vectors.ravel(), (p.vectors.T @ at_near).ravel(), (p.vectors.T @ at_far).ravel(), at_word[:, -1]])
        grad = (grad / n).astype(np.float32)
        self.squares += grad * grad
        self.flat += RATE * grad / np.sqrt(self.squares)
        self.n += n

    def learn(self, word: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        order = self.rng.permutation(len(word))
        rows = np.column_stack([word, near, far]).astype(np.uint16)  # a token's classes lie together, as they are taken
        for i in range(0, len(order), BATCH):
            self.step(*np.ascontiguousarray(rows[order[i : i + BATCH]].T, np.int64))


class Buckets(dict):
    """Buckets by the last two bytes of a word, as they are met: 65 536 and some at most."""

    def __missing__(self, tail: bytes) -> int:
        k = self[tail] = 1 + bucket(tail)
        return k


class Classes:
    """Class numbers: 0 the end (and what stands before a text), then buckets, then words."""

    def __init__(self, words: list[bytes]):
        self.of = {w: 1 + BUCKETS + k for k, w in enumerate(words)}
        self.size = 1 + BUCKETS + len(words)

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all tokens, the two classes before each, and where each text begins (and the last ends)."""
        sizes = [len(t) + 1 for t in texts]
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        word = np.zeros(begin[-1], np.int64)
        mask = np.ones(begin[-1], bool)
        mask[begin[1:] - 1] = False
        flat = list(chain.from_iterable(texts))
        found = np.fromiter(map(self.of.get, flat, repeat(-1)), np.int64, len(flat))
        other = found < 0
        tails = map(itemgetter(slice(-2, None)), compress(flat, other.tolist()))
        found[other] = np.fromiter(map(Buckets().__getitem__, tails), np.int64, np.count_nonzero(other))
        word[mask] = found
        near, far = np.zeros_like(word), np.zeros_like(word)
        near[1:] = word[:-1]  # the end of the text before is class 0 as well
        far[2:] = word[:-2]
        far[begin[:-1]] = 0
        inside = begin[:-1][np.array(sizes, int) > 1] + 1
        far[inside] = 0
        return word, near, far, begin


def train(docs: DataFrame, classes: Classes, share: np.ndarray, rounds: int = ROUNDS) -> Parameters:
    """Averaged parameters after ``rounds`` passes over all training texts."""
    texts = docs.select(text_of().alias("text"))
    flat = Parameters.start(share).flat()
    for turn in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], flat=flat, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(flat, share, seed=11 + turn)
            for b in by_bytes(batches, "text"):
                word, near, far, _ = classes.encode([tokens(t) for t in b.column(0).to_pylist()])
                trainer.learn(word, near, far)
            if trainer.n:
                values = pa.array([(trainer.n * trainer.flat.astype(np.float64)).tolist()], pa.list_(pa.float64()))
                yield pa.record_batch([pa.array([trainer.n], pa.int64()), values], names=["n", "v"])

        got = texts.mapInArrow(run, "n bigint, v array<double>").select("n", F.posexplode("v").alias("k", "v"))
        mean = got.groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).collect()  # as many rows as parameters
        if mean:
            flat = np.zeros(len(flat))
            for r in mean:
                flat[r["k"]] = r["v"]
    return Parameters.of(flat)


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    learned = rows.where("not held_out")
    counts, _ = stored(count_words(learned), "word-counts")
    n_texts = learned.count()
    by_bucket = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy((F.crc32(F.substring("word", -2, 2)) % BUCKETS).alias("k")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_all = n_texts + sum(n for n, _ in by_bucket.values())
    v_all = sum(v for _, v in by_bucket.values()) + (n_texts > 0)
    listed = {bytes(w): c for w, c in frequent(counts, LISTED).items()}
    words = sorted(listed, key=lambda w: (-listed[w], w))[:WORDS]
    classes = Classes(words)
    rest = np.array([by_bucket.get(k, (0, 0)) for k in range(BUCKETS)], float)
    for w in words:
        rest[bucket(w)] -= listed[w], 1
    share = np.concatenate([[n_texts], rest[:, 0], [listed[w] for w in words]]) + 1.0
    share /= share.sum()
    model = train(learned, classes, share)
    table, log = model.log10_table(), lambda x: np.log10(x + SMOOTH)
    rest_norm = np.log10(rest[:, 0] + SMOOTH * (rest[:, 1] + 1))
    near, far = ((model.vectors @ m @ model.vectors.T / np.log(10)).astype(np.float32) for m in (model.near, model.far))
    bias = model.bias / np.log(10)
    base_norm, base_end = float(np.log10(n_all + SMOOTH * (v_all + 1))), float(log(n_texts))
    logs = {w: (float(log(c)), 0.0 if w in classes.of else float(log(c))) for w, c in listed.items()}
    known_end = int(n_texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            hashes, texts = b.column(1).to_pylist(), [tokens(t) for t in b.column(2).to_pylist()]
            word, before, further, begin = classes.encode(texts)
            each = near[before, word].astype(np.float64) + far[further, word] + bias[word] - table[before, further]
            in_bucket = (word > 0) & (word <= BUCKETS)
            each[in_bucket] -= rest_norm[word[in_bucket] - 1]
            sums = np.add.reduceat(each, begin[:-1]) if len(texts) else []
            # Columns of two kinds of rows: words whose counts are not here, then the texts themselves.
            rare, times, rares, own = [], [], [], []
            for i, found in enumerate(texts):
                base, extra, known, before = base_end, 0.0, known_end, len(rare)
                for w, n in Counter(found).items():
                    got = logs.get(w)
                    if got is None:
                        rare.append(w)
                        times.append(n)
                    else:
                        base += n * got[0]
                        extra += n * got[1]
                        known += n
                size = len(found) + 1
                rares.append(len(rare) - before)
                own.append((size, known, base - size * base_norm, float(sums[i]) + extra))
            # A key that no word can have, and that spreads: the row of the text itself.
            rare += [b" %d %d" % (h, i) for i, h in enumerate(hashes)]
            place = pa.array(np.concatenate([np.repeat(np.arange(len(texts)), rares), np.arange(len(texts))]))
            columns = [b.column(0).take(place), b.column(1).take(place), pa.array(rare, pa.binary()), pa.array(times + [0] * len(texts), pa.int64())]
            for values, kind in zip(zip(*own), (np.int64, np.int64, np.float64, np.float64)):
                columns.append(pa.array(np.concatenate([np.zeros(len(times), kind), np.array(values, kind)])))
            yield pa.record_batch(columns, names=["doc_id", "th", "word", "n", "n_tokens", "n_known", "base", "score"])

    schema = "doc_id bigint, th bigint, word binary, n bigint, n_tokens bigint, n_known bigint, base double, score double"
    parts = rows.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)
    met = parts.join(counts, "word", "left")
    seen = F.when(F.col("n") > 0, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).otherwise(0.0)
    known = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)
    sums = met.groupBy("doc_id", "th").agg(
        F.sum((F.col("n") == 0).cast("bigint")).alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + known).alias("n_known"), F.sum(F.col("base") + seen).alias("base"), F.sum(F.col("score") + seen).alias("score"))
    # Rows that are equal share a group; each gets its part of the sums.
    return sums.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"), F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
