"""SimHash near-dedup: exact comparison of fingerprints, tile by tile, with exclusive-or and bit counts.

Documents with equal fingerprints meet first, so that only distinct fingerprints are compared. A
fingerprint's population counts, one per block of its bits, name its tile. Fingerprints at distance d have
counts that differ by d at most in sum over the blocks, so tile pairs beyond the radius are skipped; all
others are compared in full, fingerprint against fingerprint. Crowded tiles are cut into parts of a bounded
size, each pair of parts is a group of its own, and a group returns a spanning forest of its links, never all
pairs. Components are found by hooking and shortcutting over these links, between fingerprints only.

The comparison stays quadratic, divided by what the skipped tiles save; more blocks skip more. ``blocks``
is chosen from the number of distinct fingerprints so that the mean tile stays near a part's size. It
changes the work and never the result.

``keep_one``, the pipeline's stage, asks for a similarity (shared five-word shingles over all) of 0.8 or more.
Near 0.8, fingerprints of 64 bits differ in about ten of them and vary too much to tell; it therefore takes
512 bits over the distinct shingles. A first word of 64 bits sieves the pairs, the rest finds candidates, by a
radius wide enough for 0.8. Its tiles are population counts as well, of all 512 bits and in steps wider than that
radius, so that pairs whose counts lie too far apart are skipped and no others; within them are classes of shingle
counts, of which only equal and adjacent ones can reach the similarity. Most texts have population counts near 256, so
that the counts skip little there: sets of a few shingles and empty ones.

A radius loses pairs by chance, so every set also has an odd sketch: bit k tells whether an odd number of its shingle
hashes is k modulo the sketch's length. The exclusive-or of two sketches is the sketch of what only one of the sets has,
so it never has more bits than that. Pairs of equal and adjacent classes whose sketches differ in more bits than the
similarity allows cannot reach it; all others are candidates too, and none is lost.

Both only propose: the texts that candidates connect meet again with their whole
sets of shingle hashes, and a candidate links only if the exact similarity is reached. Components are formed of
these links. Crowded sets of candidates are cut into parts, as tiles are; pairs that links of a part already
connect are not counted again, so that a large group of near copies costs little.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer
words than a shingle make one shingle; equal texts and repeated rows share a component. A component's id is
its smallest doc_id, where null is smaller than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import by_bytes, drop_stored, stored

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a part of a tile, and the rows of one exclusive-or.
PART, STRIP = 4096, 256
#: The stage: shingle, similarity, words of 64 bits, differing bits of a candidate in all words (similarity 0.8 makes
#: 78 in the mean with a deviation of 8, and 96 with one of 9 for sets of four and five shingles) and in the first.
WIDE_SHINGLE, SIMILAR, WORDS, WIDE_RADIUS, FIRST_RADIUS = 5, 0.8, 8, 128, 24
#: Its tiles are few and large: a fingerprint goes to as many groups as there are parts near it, so parts are larger.
WIDE_PART = 16384
#: Its population counts go in steps from an edge on: few texts but the shortest lie outside 150 to 309 of 512 bits.
WIDE_STEP, WIDE_EDGE = 160, 150
#: Least bits of an odd sketch, shingles of a set for that many (twice as many have twice the bits), and columns of one exclusive-or.
ODD_BITS, ODD_SHINGLES, ODD_STRIP = 512, 640, 2048
#: Sets of shingles in a part of connected candidates, and shingles of all of them.
SETS, SHINGLES = 1024, 1 << 20


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; fewer words than a shingle make one."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in runs], "<u8")


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Per column of 64-bit words, the bits that more than half of the rows have."""
    n, width = hashes.shape
    ones = np.zeros(64 * width, np.int64)
    for i in range(0, n, 255):  # as many rows as a byte can count
        bits = np.unpackbits(hashes[i : i + 255].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included."""
    hashes = _hashes(text, shingle)
    return int(_majority(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Bit k is set if an odd number of the distinct hashes is k modulo the length, a power of two that grows with their number."""
    bits = ODD_BITS
    while len(hashes) > ODD_SHINGLES * (bits // ODD_BITS):
        bits *= 2
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1 == 1, bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Rows of 64-bit words: odd sketches, brought to the length of the shortest."""
    width = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in sketches])


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE, words: int = WORDS) -> tuple[bytes, int]:
    """Majority bits of ``words`` mixes of the distinct shingles' hashes, 128 bits that name their set, and their number."""
    return _wide(np.unique(_hashes(text, shingle)), words)


def _wide(hashes: np.ndarray, words: int = WORDS) -> tuple[bytes, int]:
    import xxhash

    name = xxhash.xxh3_128_digest(hashes.tobytes())
    if not len(hashes):
        return bytes(8 * words) + name, 0
    mixed = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return _majority(np.ascontiguousarray(mixed ^ (mixed >> np.uint64(31)))).tobytes() + name, len(hashes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """``(doc_id, th, fp)`` of every row, with ``wide`` also ``size``, ``ones`` and ``odd``; a map without a shuffle.

    ``th`` is a hash of the text, which tells rows of one doc_id apart, ``fp`` the fingerprint: a signed long,
    or binary if wide, with the name of the set behind, so that equal ones are equal sets. ``ones`` is its population count,
    ``odd`` the odd sketch of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            texts = b.column(2).to_pylist()
            if wide:
                found, odd = [], []
                for t in texts:
                    hashes = np.unique(_hashes(t, shingle))
                    found.append(_wide(hashes))
                    odd.append(odd_sketch(hashes))
                ones = np.bitwise_count(_bits([f for f, _ in found])).sum(1, dtype=np.int64)
                columns = [pa.array([f for f, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64()), pa.array(ones), pa.array(odd, pa.binary())]
            else:
                columns = [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]
            yield pa.record_batch([b.column(0), b.column(1), *columns], names=["doc_id", "th", "fp", "size", "ones", "odd"][: 2 + len(columns)])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, th bigint, " + ("fp binary, size bigint, ones bigint, odd binary" if wide else "fp bigint"))


def _masks(blocks: int) -> list[int]:
    """Masks that deal the 64 bits into blocks of consecutive bits, as signed longs."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tile(fp: Column, blocks: int) -> Column:
    """Population counts of the blocks, 7 bits each."""
    key = F.lit(0).cast("bigint")
    for mask in _masks(blocks):
        key = key * 128 + F.bit_count(fp.bitwiseAND(F.lit(mask))).cast("bigint")
    return key


def offsets(blocks: int, radius: int) -> list[int]:
    """Differences of tile keys within the radius, each pair of tiles once: zero and the positive ones."""
    found = []
    for steps in product(range(-radius, radius + 1), repeat=blocks):
        if sum(map(abs, steps)) <= radius:
            value = 0
            for s in steps:
                value = value * 128 + s
            if value >= 0:
                found.append(value)
    return sorted(found)


def size_class(size: Column, similar: float) -> Column:
    """Classes of shingle counts: sets whose classes are neither equal nor adjacent cannot reach the similarity."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-np.log(similar).item())).cast("bigint")


def wide_tile(size: Column, ones: Column, similar: float, radius: int) -> tuple[Column, list[int]]:
    """Tile keys of wide fingerprints by population count and class of shingle counts, and the differences of near ones.

    Sets of which one is smaller than ``similar`` times the other cannot reach it: their classes are not adjacent.
    Fingerprints within the radius have population counts that differ by the radius at most: of equal or adjacent steps.
    """
    width = max(WIDE_STEP, radius + 1)
    below = -(-WIDE_EDGE // width)  # steps below the edge
    kinds = 2 * (below + (64 * WORDS - WIDE_EDGE) // width + 1)
    count = F.floor((ones - WIDE_EDGE) / width).cast("bigint") + below
    return size_class(size, similar) * kinds + count, [0, 1, kinds - 1, kinds, kinds + 1]


def forest(fps: np.ndarray, left: int, radius: int, first: int) -> np.ndarray:
    """Per row of 64-bit words the smallest row it is linked to through the group.

    The first ``left`` rows meet the others; ``left == 0`` compares all rows with each other. Rows link if their
    first words differ in at most ``first`` bits and all words in at most ``radius``.
    """
    label = np.arange(len(fps))
    other = np.arange(left, len(fps)) if left else label
    for i in range(0, left or len(fps), STRIP):
        rows = np.arange(i, min(i + STRIP, left or len(fps)))
        differ = np.bitwise_count(fps[rows, None, 0] ^ fps[None, other, 0])
        a, b = np.nonzero(differ <= first)
        if fps.shape[1] > 1:
            rest = np.bitwise_count(fps[rows[a], 1:] ^ fps[other[b], 1:]).sum(1, dtype=np.int64)
            close = differ[a, b] + rest <= radius
            a, b = a[close], b[close]
        label = _hooked(label, rows[a], other[b])
    return label


def _hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links ``a, b``: the larger label is hooked below the smaller, then shortcut."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def allowed(sizes: np.ndarray, others: np.ndarray, similar: float) -> np.ndarray:
    """Shingles that only one of two sets may have, by their sizes, where they reach the similarity."""
    return (sizes + others) * ((1 - similar) / (1 + similar)) + 1e-6


def odd_forest(odd: np.ndarray, sizes: np.ndarray, left: int, similar: float) -> np.ndarray:
    """As ``forest``, with links between all rows whose odd sketches do not rule the similarity out."""
    label = np.arange(len(odd))
    end = left or len(odd)
    for i in range(0, end, STRIP):
        rows = np.arange(i, min(i + STRIP, end))
        for j in range(left or i, len(odd), ODD_STRIP):
            other = np.arange(j, min(j + ODD_STRIP, len(odd)))
            most = allowed(sizes[rows].max(), sizes[other].max(), similar)
            # As many words for all pairs as tell most of them apart; the others of the few that are left.
            words = min(odd.shape[1], int(most / 32) + 4)
            differ = np.zeros((len(rows), len(other)), np.uint16)
            for k in range(words):
                differ += np.bitwise_count(odd[rows, None, k] ^ odd[None, other, k])
            a, b = np.nonzero(differ <= most)
            a, b = rows[a], other[b]
            fits = (a != b) & (label[a] != label[b]) & (np.minimum(sizes[a], sizes[b]) >= similar * np.maximum(sizes[a], sizes[b]) - 1e-6)
            a, b = a[fits], b[fits]
            for k in range(0, len(a), ODD_STRIP):  # a group of near copies leaves many
                c, d = a[k : k + ODD_STRIP], b[k : k + ODD_STRIP]
                near = np.bitwise_count(odd[c] ^ odd[d]).sum(1, dtype=np.int64) <= allowed(sizes[c], sizes[d], similar)
                label = _hooked(label, c[near], d[near])
    return label


def sized_odd(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketches and sizes of names with both behind them: wide fingerprint, name of the set, size, sketch."""
    start = 8 * WORDS + 16
    return folded([x[start + 8 :] for x in names]), np.array([int.from_bytes(x[start : start + 8], "big") for x in names])


def _bits(names: np.ndarray) -> np.ndarray:
    """The words of wide fingerprints, without the names of their sets."""
    return np.frombuffer(b"".join(names), np.uint64).reshape(len(names), -1)[:, :WORDS]


def exact_forest(fps: np.ndarray, sets: list[np.ndarray], left: int, radius: int, first: int, similar: float) -> np.ndarray:
    """As ``forest``, but rows link if and only if their sets have the similarity.

    Pairs that are neither within the radius nor possible by their odd sketches are not counted.
    """
    label, sizes = np.arange(len(fps)), np.array([len(x) for x in sets])
    odd = folded([odd_sketch(x) for x in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes, mark = np.split(codes, np.cumsum(sizes)[:-1]), np.zeros(len(values), bool)
    for i in range(left or len(fps)):
        other = np.arange(left or i + 1, len(fps))
        alike = np.minimum(sizes[i], sizes[other]) >= similar * np.maximum(sizes[i], sizes[other]) - 1e-6
        other = other[alike & (label[other] != label[i])]
        differ = np.bitwise_count(fps[i] ^ fps[other])
        close = (differ[:, 0] <= first) & (differ.sum(1, dtype=np.int64) <= radius)
        close |= np.bitwise_count(odd[i] ^ odd[other]).sum(1, dtype=np.int64) <= allowed(sizes[i], sizes[other], similar)
        other = other[close]
        if not len(other):
            continue
        mark[codes[i]] = True
        shared = np.array([np.count_nonzero(mark[codes[j]]) for j in other])
        mark[codes[i]] = False
        met = np.append(label[other[shared / np.maximum(sizes[i] + sizes[other] - shared, 1) >= similar]], label[i])
        label[np.isin(label, met)] = met.min()
    return label


def links(tiled: DataFrame, steps: list[int], radius: int, first: int, part: int = PART, odd: float | None = None) -> DataFrame:
    """``(fp, low)``: links between distinct fingerprints of ``tiled (fp, key)`` that connect what the radius connects.

    Tiles whose keys differ by one of ``steps`` (zero and positive) are compared. With a similarity ``odd``, sizes and odd
    sketches stand behind the fingerprints (``sized_odd``) and link in place of the radius.
    """
    # The number of tiles is bounded by what a key can be, not by the rows.
    sizes = tiled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    sizes, folder = stored(sizes, "tile-sizes")
    near = sizes.select(F.col("key").alias("key_a"), F.col("parts").alias("parts_a"),
                        F.explode(F.lit(steps)).alias("step")).withColumn("key_b", F.col("key_a") + F.col("step"))
    pairs = near.join(sizes.select(F.col("key").alias("key_b"), F.col("parts").alias("parts_b")), "key_b").select(
        "key_a", "parts_a", "key_b", "parts_b")
    dealt = tiled.join(sizes, "key").select("fp", "key", "parts", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))

    def side(name: str) -> DataFrame:
        """Every fingerprint once per pair of parts that it takes part in on this side."""
        other = "b" if name == "a" else "a"
        mine = pairs.withColumnRenamed(f"key_{name}", "key").withColumnRenamed(f"key_{other}", "other").withColumnRenamed(
            f"parts_{other}", "n")
        rows = dealt.join(mine.select("key", "other", "n"), "key").select(
            "fp", "key", "part", "other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other_part"))
        own, far = F.struct("key", "part"), F.struct(F.col("other").alias("key"), F.col("other_part").alias("part"))
        a, b = (own, far) if name == "a" else (far, own)
        rows = rows.select("fp", a.alias("a"), b.alias("b"))
        # Within one tile each pair of parts once, and a part with itself on one side only.
        inside = F.col("a") <= F.col("b") if name == "a" else F.col("a") < F.col("b")
        return rows.where((F.col("a.key") != F.col("b.key")) | inside).select(
            "fp", F.col("a.key").alias("ka"), F.col("a.part").alias("pa"), F.col("b.key").alias("kb"), F.col("b.part").alias("pb"),
            F.lit(name == "b").alias("right"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["right", "fp"])
        names = group["fp"].to_numpy()
        left = int((~group["right"]).sum())
        left = left if left < len(names) else 0
        if odd is not None:
            label = odd_forest(*sized_odd(names), left, odd)
        else:
            label = forest(names.view(np.uint64).reshape(-1, 1) if names.dtype != object else _bits(names), left, radius, first)
        linked = np.nonzero(label != np.arange(len(label)))[0]
        return pd.DataFrame({"fp": names[linked], "low": names[label[linked]]})

    both = side("a").unionByName(side("b"))
    kind = dict(tiled.dtypes)["fp"]
    return both.groupBy("ka", "pa", "kb", "pb").applyInPandas(compare, f"fp {kind}, low {kind}")


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``(fp, root, shingles)`` of ``members (fp, root, doc_id, th)``: the hashes of each one's distinct shingles."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    few = members.select("fp", "root", F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"))
    met = texts.join(few, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))).select("fp", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            found = [np.unique(_hashes(t, WIDE_SHINGLE)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["fp", "root", "shingles"])

    # Repeated rows of one doc_id and text come once.
    return met.mapInArrow(run, "fp binary, root binary, shingles binary").dropDuplicates(["fp"])


def verified(sets: DataFrame, similar: float, radius: int, first: int, part: int = SETS, shingles: int = SHINGLES) -> DataFrame:
    """``(fp, low)``: links that connect what candidates of exact similarity connect, within each root of ``sets``."""
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles") / 8).alias("s"))
    sizes, _ = stored(sizes.select("root", F.ceil(F.greatest(F.col("n") / part, F.col("s") / shingles, F.lit(1))).cast("int").alias("parts")), "set-parts")
    dealt = sets.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "fp", "shingles", "root", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"),
        (F.col("part") > F.col("other")).alias("right"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["right", "fp"])
        names, right = group["fp"].to_numpy(), group["right"].to_numpy(bool)
        left = int((~right).sum())
        if group["a"].iloc[0] != group["b"].iloc[0] and left in (0, len(group)):  # one of the parts has no rows
            return pd.DataFrame({"fp": [], "low": []})
        found = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        label = exact_forest(_bits(names), found, left if left < len(names) else 0, radius, first, similar)
        linked = np.nonzero(label != np.arange(len(label)))[0]
        return pd.DataFrame({"fp": names[linked], "low": names[label[linked]]})

    return rows.groupBy("root", "a", "b").applyInPandas(compare, "fp binary, low binary")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (x, y)``; the root is the component's smallest node.

    Each round links all neighbours of a node to the smallest of them (first those above the node, then
    those below), which halves distances; rounds end when nothing changes. Stars have few rows per centre
    and are aggregated before they are shuffled; every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    current, folder = stored(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    total = None
    while True:
        # Large star: neighbours above a node go to the smallest neighbour, the node included.
        both = current.union(current.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # The smallest neighbours are a table of their own, so that Spark may split the rows of a frequent centre.
        low, low_folder = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "low")
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        # Small star: the neighbours below a node, and the node, go to the smallest of them.
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array("x", "y")).alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        following, fresh = stored(small, "links")
        measure = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        drop_stored(spark, folder)
        drop_stored(spark, low_folder)
        current, folder = following, fresh
        if tuple(measure) == total:
            return current.select(F.col("x").alias("node"), F.col("y").alias("root"))
        total = tuple(measure)


def choose_blocks(n: int, part: int = PART) -> int:
    """The least number of blocks at which a tile of usual counts has about ``part`` fingerprints."""
    blocks = 1
    while blocks < 8 and n / (4.13 * (16 / blocks) ** 0.5) ** blocks > part / 2:
        blocks += 1
    return blocks


def _grouped(fps: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, th, fp, component_id, component_th)`` of all rows, from the links between distinct fingerprints."""
    roots = components(found.select(F.col("fp").alias("x"), F.col("low").alias("y")))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least, _ = stored(member.groupBy("root").agg(F.min("least").alias("first")), "least")
    named, _ = stored(member.select("fp", "root").join(least, "root").select("fp", "first"), "named")
    return fps.join(named, "fp").select(
        "doc_id", "th", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("component_th"))


def group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, th, fp, component_id, component_th)`` of every row of ``docs``; the last two name the smallest row."""
    fps, _ = stored(fingerprints(docs, shingle), "fingerprints")
    distinct, _ = stored(fps.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("least")), "distinct")
    blocks = choose_blocks(distinct.count())
    tiled = distinct.select("fp", tile(F.col("fp"), blocks).alias("key"))
    return _grouped(fps, distinct, links(tiled, offsets(blocks, radius), radius, radius))


def group_similar(docs: DataFrame, similar: float = SIMILAR, radius: int = WIDE_RADIUS) -> DataFrame:
    """The same by wide fingerprints and exact counts: texts are linked if ``similar`` of their distinct five-word shingles are shared."""
    fps, _ = stored(fingerprints(docs, WIDE_SHINGLE, wide=True), "wide-fingerprints")
    distinct, _ = stored(fps.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.min("size").alias("size"), F.min("ones").alias("ones"), F.min("odd").alias("odd")), "wide-distinct")
    key, steps = wide_tile(F.col("size"), F.col("ones"), similar, radius)
    near = links(distinct.select("fp", key.alias("key")), steps, radius, FIRST_RADIUS, WIDE_PART)
    sized = F.concat("fp", F.unhex(F.lpad(F.hex("size"), 16, "0")), "odd").alias("fp")
    possible = links(distinct.select(sized, size_class(F.col("size"), similar).alias("key")), [0, 1], radius, FIRST_RADIUS, WIDE_PART, similar)
    width = 8 * WORDS + 16
    near, _ = stored(near.unionByName(possible.select(*[F.substring(c, 1, width).alias(c) for c in ("fp", "low")])).distinct(), "candidates")
    roots = components(near.select(F.col("fp").alias("x"), F.col("low").alias("y")))
    roots = roots.union(roots.select("root", "root").distinct())  # a root is no node of its own
    members = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least.doc_id", "least.th")
    sets, _ = stored(_sets(docs, members), "shingle-sets")
    return _grouped(fps, distinct, verified(sets, similar, radius, FIRST_RADIUS))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, similar: float = SIMILAR, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row of each group of similar texts, that of the smallest doc_id and text hash; all columns are kept."""
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("component_th"))
    ids = group_similar(docs, similar, radius).where(first).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    ids, _ = stored(ids.select(F.col("doc_id").alias("sh_id"), F.col("th").alias("sh_th"), "n"), "kept")

    def of(few: DataFrame) -> DataFrame:
        return docs.join(few, docs["doc_id"].eqNullSafe(few["sh_id"]) & (F.xxhash64(docs["text"].cast("string")) == few["sh_th"]), "left_semi")

    return of(ids.where("n = 1")).unionByName(of(ids.where("n > 1")).dropDuplicates(["doc_id", "text"]))
