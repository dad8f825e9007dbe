"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated on labelled rows.

Every text gives a handful of rule statistics. Random splits over labelled good rows, with a small
share of bad ones that widens the split ranges, make trees; texts that few splits isolate are
anomalous. The threshold on the anomaly score is chosen on the labelled rows. Only the fitting uses
a sample, of at most ``fit_rows`` labelled rows taken by a hash order; every text is measured whole
and judged. Statistics of short texts are noisy and are drawn towards those of a usual text.

Defined results: a null text has no words and fails the base rules; with no labelled rows the
forest passes everything; repeated rows and ties get equal verdicts; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import by_bytes

#: Labelled rows used for the fit, trees, and rows drawn per tree.
FIT_ROWS, TREES, TREE_ROWS = 20_000, 100, 256
#: Largest share of labelled good rows that the threshold may reject.
GOOD_LOSS = 0.002
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 0.30

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "upper", "punctuation", "variety")
#: A text of so many words counts half, the usual text the other half.
PRIOR_WORDS = 20
#: Bad rows in the forest's sample, as a share of the good ones.
BAD_SHARE = 0.03


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Word positions inside windows that occur twice or more in the list, first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mix = np.zeros(n, np.uint64)
    for k in range(window):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.sort(mix)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    seen: dict[tuple[bytes, ...], int] = {}
    found = np.nonzero(np.isin(mix, twice))[0]  # equal windows have equal codes; the words decide
    windows = [tuple(words[i : i + window]) for i in found]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for i, w in zip(found, windows) if seen[w] > 1], np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """``COUNTS`` and ``FEATURES`` of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    dense = raw.translate(None, _SPACE)
    size = len(dense)
    chars = sum(1 for _ in dense.decode("utf-8", "surrogatepass")) if not dense.isascii() else size
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper = size - len(dense.translate(None, _UPPER))
    lower = size - len(dense.translate(None, _LOWER))
    n = max(len(words), 1)
    features = (
        chars / n,
        symbols / n,
        upper / max(upper + lower, 1),
        (size - len(dense.translate(None, _PUNCT))) / max(size, 1),
        math.log(1 + len(set(words))) / math.log(1 + n),
    )
    return (len(words), chars, symbols, dup, repeats), features


def base_failed(counts: tuple[int, ...]) -> bool:
    """Too few words, or more than the allowed share of repeated words."""
    return counts[0] < LEAST_WORDS or 100 * counts[4] > round(100 * MOST_REPEATED) * counts[0]


def _mean_path(n: float) -> float:
    """Expected path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as flat arrays: split feature (-1 in leaves), split value, children, and the leaf's path length."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    scale: float
    usual: np.ndarray
    threshold: float = math.inf

    def inputs(self, features: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        trust = np.asarray(n_words, float)[:, None]
        return self.usual + (features - self.usual) * trust / (trust + PRIOR_WORDS)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1; near 1 means isolated by few splits."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.value[at]
                at = np.where(inner, self.child[at, right.astype(int)], at)
            total += self.path[at]
        return np.exp2(-total / (max(len(self.roots), 1) * self.scale))

    def rejects(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x) > self.threshold if len(self.roots) else np.zeros(len(x), bool)


def grow(x: np.ndarray, usual: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """Trees over random subsets of ``x``; the same rows give the same trees."""
    rng = np.random.default_rng(seed)
    feature, value, child, path, roots = [], [], [], [], []
    deepest = max(1, math.ceil(math.log2(max(min(rows, len(x)), 2))))

    def node(part: np.ndarray, depth: int) -> int:
        me = len(feature)
        feature.append(-1), value.append(0.0), child.append([me, me]), path.append(depth + _mean_path(len(part)))
        low, high = part.min(0), part.max(0)
        wide = np.nonzero(high > low)[0]
        if depth < deepest and len(part) > 1 and len(wide):
            f = int(rng.choice(wide))
            cut = rng.uniform(low[f], high[f])
            right = part[:, f] >= cut
            if right.any() and not right.all():
                feature[me], value[me] = f, cut
                child[me] = [node(part[~right], depth + 1), node(part[right], depth + 1)]
        return me

    for _ in range(trees if len(x) else 0):
        roots.append(node(x[rng.permutation(len(x))[:rows]], 0))
    arrays = np.array(feature, int), np.array(value), np.array(child, int).reshape(-1, 2), np.array(path)
    return Forest(*arrays, np.array(roots, int), max(_mean_path(min(rows, len(x))), 1e-9), usual)


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, loss: float = GOOD_LOSS) -> Forest:
    """The lowest threshold above which at most ``loss`` of the good rows lie.

    Without good or without bad rows there is nothing to tell apart, and the threshold stays at infinity.
    """
    if good.any() and not good.all():
        scores = np.sort(forest.scores(x[good]))
        edge = scores[max(0, math.ceil(len(scores) * (1 - loss)) - 1)]
        bad = np.sort(forest.scores(x[~good]))
        above = bad[bad > edge]
        # Half way to the nearest rejected row, so that unseen good rows have the same room.
        forest.threshold = float(edge + (above[0] - edge) / 2) if len(above) else math.inf
    return forest


def train(features: np.ndarray, n_words: np.ndarray, good: np.ndarray) -> Forest:
    """Forest and threshold from labelled rows, in the order given."""
    usual = np.median(features[good] if good.any() else features, axis=0) if len(features) else np.zeros(len(FEATURES))
    forest = grow(np.zeros((0, len(FEATURES))), usual)
    if not good.any():
        return forest
    x = forest.inputs(features, n_words)
    bad = np.nonzero(~good)[0][: int(BAD_SHARE * good.sum())]
    return calibrate(grow(np.concatenate([x[good], x[bad]]), usual), x, good)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Forest and threshold from at most ``fit_rows`` labelled rows that pass the base rules."""
    marks = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    few = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(marks), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            got = [(i, q, measure(t)) for i, q, t in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)))]
            got = [(i, q, [*f, float(c[0])]) for i, q, (c, f) in got if not base_failed(c)]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()))
            columns = [pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch(columns, names=["doc_id", "quality", "features"])

    rows = few.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")
    measured = rows.mapInArrow(run, "doc_id bigint, quality int, features array<double>")
    got = measured.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features")).toPandas()
    got = got.sort_values("doc_id")
    x = np.array(got["features"].tolist(), float).reshape(-1, len(FEATURES) + 1)
    return train(x[:, :-1], x[:, -1], got["quality"].to_numpy() > 0)


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """Per row: doc_id, the counts, ``base_failed``, ``kept`` and ``score``; a map over all rows without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            yield _judged(forest, b.column(0), b.column(1))

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _judged(forest: Forest, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    got = [measure(t) for t in texts.to_pylist()]
    x = forest.inputs(np.array([f for _, f in got]).reshape(-1, len(FEATURES)), np.array([c[0] for c, _ in got]))
    failed = np.array([base_failed(c) for c, _ in got], bool)
    counts = [pa.array([c[k] for c, _ in got], pa.int64()) for k in range(len(COUNTS))]
    score = forest.scores(x) if len(forest.roots) else np.zeros(len(x))
    kept = ~failed & ~forest.rejects(x)
    return pa.record_batch([ids, *counts, pa.array(failed), pa.array(kept), pa.array(score)],
                           names=["doc_id", *COUNTS, "base_failed", "kept", "score"])


def keep(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text passes the rules and the forest."""
    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        return _judged(forest, pa.nulls(len(texts), pa.int64()), texts).column("kept")

    return docs.where(passes(F.col("text").cast("string")))
