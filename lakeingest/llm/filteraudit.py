"""What filters remove in every order of applying them, with a counting Bloom filter in front of the exact duplicate check.

Counts over documents are additive, and which documents a filter removes at a step depends on a document only through the
set of filters it fails. So documents shrink to counts per part and set ("mask"), and all orders come from these.

The duplicate filter fails texts that equal the text of a smaller doc_id. Every task counts the cells of its texts' hashes;
the sketches are added, block by block. A text of which some cell was met once only is unique. The others, possible
repeats, are grouped by their full text, combined in the tasks first, for the smallest doc_id; the documents that hold it
join back by doc_id and digest, which no group of copies makes uneven.

The sketch has ``CELLS`` cells of two bits for each document, at most ``MOST_CELLS`` (256 MB), and goes to every executor.
Beyond 134 million documents it clears fewer texts: more texts are then compared, and no result changes. Shuffles: sparse
sketches, the texts of possible repeats, and narrow rows of documents (id, part, mask, digest) to meet labels and minima.

Defined results: a null text is empty, a null part the empty string; a null doc_id has no label and is neither a duplicate
nor the original of one; rows with the same doc_id are counted each, and none is a duplicate of another; a document with
several labels counts as good (toxic) if one says so; ties do not arise, since only smaller ids count; whole texts count,
however long; an empty table has no parts and so no rows; extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import text_of

#: Cells per document, the most cells, and the cells of a block (the unit of merging).
CELLS, MOST_CELLS, BLOCK = 8, 1 << 30, 1 << 20
#: Hashes that a task collects before it counts and emits them.
HELD = 1 << 20
_SKETCH = "block bigint, cells binary, counts binary"
_RESULT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
           "good_lost bigint, toxic_lost bigint, shapley bigint")


def cells_for(n: int) -> int:
    """A power of two, so that the cells of a hash are bits of it."""
    return max(BLOCK, min(MOST_CELLS, 1 << max(CELLS * n - 1, 1).bit_length()))


def _cells(hashes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    bits = hashes.view(np.uint64)
    return bits & np.uint64(m - 1), bits >> np.uint64(33) & np.uint64(m - 1)


def _partial(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """The cells that a task's hashes meet, with counts up to 255, by block."""

    def counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(np.concatenate([np.concatenate(_cells(h, m)) for h in parts]), return_counts=True)
        cuts = np.flatnonzero(np.diff(cells // BLOCK, prepend=cells[:1] // BLOCK + 1))
        counts = np.minimum(counts, 255).astype(np.uint8)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cells)]):
            block = int(cells[a]) // BLOCK
            part = (cells[a:b] - np.uint64(block * BLOCK)).astype("<u4")
            yield pa.record_batch([[block], [part.tobytes()], [counts[a:b].tobytes()]], names=["block", "cells", "counts"])

    held, n = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy())
        n += b.num_rows
        if n >= HELD:
            yield from counted(held)
            held, n = [], 0
    if n:
        yield from counted(held)


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """A block's counts added, and kept up to 2 in two bits each."""
    total = np.zeros(BLOCK, np.uint8)
    for cells, counts in zip(parts["cells"], parts["counts"]):
        at = np.frombuffer(cells, "<u4")  # distinct within a part
        total[at] = np.minimum(total[at] + np.minimum(np.frombuffer(counts, np.uint8), 2), 2)
    quads = total.reshape(-1, 4)
    packed = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return pd.DataFrame({"block": [int(parts["block"].iloc[0])], "packed": [packed.tobytes()]})


def sketch(hashes: DataFrame, n: int) -> np.ndarray:
    """The merged counting Bloom filter of 64-bit hashes (first column), four cells a byte; at most ``MOST_CELLS / 4`` bytes."""
    m = cells_for(n)
    partial = hashes.mapInArrow(lambda batches: _partial(batches, m), _SKETCH)
    merged = partial.groupBy("block").applyInPandas(_merged, "block bigint, packed binary")
    out = np.zeros(m // 4, np.uint8)
    for row in merged.toLocalIterator():
        out[row["block"] * (BLOCK // 4) :][: BLOCK // 4] = np.frombuffer(row["packed"], np.uint8)
    return out


def possible_repeats(hashes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Whether every cell of a hash was met twice or more."""
    out = np.ones(len(hashes), bool)
    for cells in _cells(hashes, 4 * len(packed)):
        out &= (packed[cells >> np.uint64(2)] >> (2 * (cells & np.uint64(3))).astype(np.uint8) & 3) >= 2
    return out


def duplicates(docs: DataFrame, id_column: Column, text: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` of every document with ``duplicate``: whether a smaller id has an equal text."""
    spark = docs.sparkSession
    packed = sketch(docs.select(F.xxhash64(text)), docs.count())
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(possible_repeats(h.to_numpy(np.int64), shared.value))

    digest = F.sha2(F.col("fa_text"), 256)
    rows = docs.select(id_column.cast("bigint").alias("fa_id"), text.alias("fa_text"), *(c.alias(k) for k, c in keep.items()))
    rows = rows.withColumn("fa_possible", possible(F.xxhash64("fa_text")))
    firsts = rows.where("fa_possible").groupBy("fa_text").agg(F.min("fa_id").alias("first_id"))
    firsts = firsts.select("first_id", digest.alias("first_digest"))
    # No other row needs a digest; where the id is null or the text unique, nothing joins.
    narrow = rows.select("fa_id", *keep, F.when(F.col("fa_possible"), digest).alias("fa_digest"))
    met = narrow.join(firsts, (F.col("fa_id") == F.col("first_id")) & (F.col("fa_digest") == F.col("first_digest")), "left")
    repeat = F.col("fa_digest").isNotNull() & F.col("fa_id").isNotNull() & F.col("first_id").isNull()
    return met.select("fa_id", *keep, repeat.alias("duplicate"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, Column], duplicate: int) -> DataFrame:
    """``(part, mask, n, good, toxic)``. Bit k of a mask is the k-th filter; the duplicate filter has bit ``duplicate``."""
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(filters.values()) if k != duplicate), F.lit(0))
    keep = {"fa_part": part, "fa_mask": mask}
    found = duplicates(docs, F.col("doc_id"), text_of(), keep)
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    known = known.groupBy("label_id").agg(F.max("g").alias("g"), F.max("t").alias("t"))
    whole = F.col("fa_mask") + F.when(F.col("duplicate"), F.lit(1 << duplicate)).otherwise(0)
    return (
        found.join(known, F.col("fa_id") == F.col("label_id"), "left")
        .groupBy(F.col("fa_part").alias("part"), whole.alias("mask"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("g").alias("good"), F.count_if("t").alias("toxic"))
    )


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """The rows of every part, order and step, from the mask counts (at most ``2 ** len(letters)`` rows per part)."""
    k, masks = len(letters), np.arange(1 << len(letters))
    plans, removed, kept, redundant, own = [], [], [], [], []
    for order in permutations(range(k)):
        gone = np.zeros(len(masks), bool)
        for step, f in enumerate(order):
            fails = (masks >> f & 1).astype(bool)
            plans.append(("".join(letters[j] for j in order), step + 1, f))
            removed.append(fails & ~gone), redundant.append(fails & gone), own.append(masks == 1 << f)
            gone |= fails
            kept.append(~gone)
    removed, kept, redundant, own = (np.array(x, np.int64) for x in (removed, kept, redundant, own))
    which = np.array([f for *_, f in plans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                table = np.zeros((len(masks), 3), np.int64)
                for c in cells:
                    table[c["mask"]] = c["n"], c["good"], c["toxic"]
                lost = removed @ table
                n, share = table[:, 0], np.bincount(which, lost[:, 0], k).astype(np.int64)
                columns = [kept @ n, lost[:, 0], redundant @ n, own @ n, lost[:, 1], lost[:, 2], share[which]]
                head = [[part] * len(plans), [p[0] for p in plans], pa.array([p[1] for p in plans], pa.int32())]
                yield pa.record_batch([*head, *columns], names=[x.split()[0] for x in _RESULT.split(", ")])

    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(run, _RESULT)


def standard_filters() -> dict[str, Column]:
    """Failure conditions of the audit; ``E`` is the duplicate filter."""
    text = text_of()
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
        "E": F.lit(None).cast("boolean"),
    }


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What the standard filters do in each of their 120 orders, per value of the column ``part``."""
    filters = standard_filters()
    counts = mask_counts(docs, labels, F.coalesce(F.col(part).cast("string"), F.lit("")), filters, "ABCDE".index("E"))
    return orders(counts, "".join(filters))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w
), m AS (
  SELECT part, mask, count(*) AS n,
    count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
    count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM f GROUP BY part, mask
), l AS (
  SELECT letter, bit FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x (letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::BIGINT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE (mask & (before + bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE (mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE (mask & bit) > 0 AND (mask & before) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE (mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE (mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
