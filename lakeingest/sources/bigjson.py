"""JSON documents of any size, cut into their records by many tasks.

A file is read in ranges of bytes. What a range does to a scanner is a small summary that composes: the parity of its
quotes, and the change of depth for either start (outside or inside a string). Sums over the ranges of a file, in order,
give every range its start; whether its first byte is escaped shows in the bytes before it. With known starts, ranges
report where the document ends and which member is its first list of objects, and then cut the records that begin in them.

Structure is decided here by brackets, commas and quotes alone. Whether the records, and what stands around them, are valid
is decided for each as for any other value; a document is valid when all of them are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeingest.session import spread
from lakeingest.sources.remote import open_input, scan_uri

RANGE_BYTES = 8 << 20
UNIT_BYTES = 8 << 20
_MARKS = np.zeros(256, bool)
_MARKS[list(b"{}[],")] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
_BOM = b"\xef\xbb\xbf"

_RANGE = "path string, start bigint, stop bigint"
_SUMMARY = _RANGE + ", quotes bigint, outside bigint, inside bigint"
_PLACES = ("path string, start bigint, first string, last bigint, closed bigint, before_commas bigint, before_objects bigint, "
           "before_end bigint, list_start bigint, list_end bigint, open_start bigint, open_is_list boolean, open_commas bigint, "
           "open_objects bigint")
#: ``kind``: records of the list between ``list_start`` and ``list_end``; a single record; or no single value.
_SHAPE = "path string, kind string, depth bigint, list_start bigint, list_end bigint, last bigint"
_UNITS = "unit string, uri string, block bigint, seq bigint, part string"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _read(file, start: int, stop: int) -> np.ndarray:
    file.seek(start)
    return np.frombuffer(file.read(stop - start), np.uint8)


def _escaped(file, start: int) -> bool:
    """Whether an odd number of backslashes stands in front of a place."""
    n, at = 0, start
    while at:
        block = _read(file, max(0, at - 4096), at)
        others = np.flatnonzero(block != 92)
        n += len(block) - 1 - (others[-1] if len(others) else -1)
        if len(others):
            break
        at -= len(block)
    return bool(n % 2)


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    quotes = np.flatnonzero(data == 34)
    slashes = data == 92
    if not slashes.any() and not escaped:
        return quotes
    place = np.arange(len(data), dtype=np.int32)
    other = np.maximum.accumulate(np.where(slashes, np.int32(-1), place))  # the last byte up to here that is no backslash
    before = np.where(quotes > 0, other[quotes - 1], -1)
    run = np.where(quotes > 0, quotes - 1 - before, 0) + (escaped & (before < 0))
    return quotes[run % 2 == 0]


def _marks(data: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Places of brackets and commas outside strings."""
    places = np.flatnonzero(_MARKS[data])
    return places[np.searchsorted(quotes, places) % 2 == int(inside)]


@dataclass
class Scanned:
    """Brackets and commas of a range: their places in the file, bytes, and the depth behind each."""

    at: np.ndarray
    mark: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, start: int, escaped: bool, inside: bool, depth: int) -> "Scanned":
        places = _marks(data, _quotes(data, escaped), inside)
        mark = data[places]
        return cls(places + start, mark, depth + np.cumsum(_STEP[mark]))


def ranges(spark: SparkSession, paths: list[str], size: int) -> DataFrame:
    """``(path, start, stop)`` of all ranges, spread over the tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as file:
                    end = file.size()
                yield _batch(_RANGE, [(path, s, min(s + size, end)) for s in range(0, end, size)])

    files = spread(spark.createDataFrame([(p,) for p in paths], "path string"), "path")
    return spread(files.mapInArrow(cut, _RANGE), "path", "start")


def _each(df: DataFrame, schema: str, work) -> DataFrame:
    """``work(file, row)`` gives the batches of every row, a range of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as file:
                    yield from work(file, row)

    return df.mapInArrow(run, schema)


def _summary(file, row: dict) -> Iterator[pa.RecordBatch]:
    data = _read(file, row["start"], row["stop"])
    quotes = _quotes(data, _escaped(file, row["start"]))
    steps = [int(_STEP[data[_marks(data, quotes, inside)]].sum()) for inside in (False, True)]
    yield _batch(_SUMMARY, [(row["path"], row["start"], row["stop"], len(quotes) % 2, *steps)])


def starts(parts: DataFrame) -> DataFrame:
    """Whether every range begins inside a string, and at which depth: sums over the ranges before it."""
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    sums = _each(parts, _SUMMARY, _summary).withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    step = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    return sums.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0))).select("path", "start", "stop", "in_string", "depth")


def _places(file, row: dict) -> Iterator[pa.RecordBatch]:
    """Where a range ends the document, and the lists it holds of the first level, whole or in part."""
    start = row["start"]
    data = _read(file, start, row["stop"])
    found = Scanned.of(data, start, _escaped(file, start), row["in_string"], row["depth"])
    shown = np.flatnonzero(~_BLANK[data])
    if start == 0 and data[:3].tobytes() == _BOM:
        shown = shown[shown >= 3]
    first = chr(data[shown[0]]) if len(shown) else None
    last = int(shown[-1]) + start if len(shown) else None
    closed = found.at[(found.depth == 0) & (_STEP[found.mark] < 0)]
    # Inside the list or object that is open at depth 2: commas, and objects that begin.
    commas = found.at[(found.mark == 44) & (found.depth == 2)]
    objects = found.at[(found.mark == 123) & (found.depth == 3)]
    opened = (_STEP[found.mark] > 0) & (found.depth == 2)
    ended = found.at[(_STEP[found.mark] < 0) & (found.depth == 1)]
    count = lambda places, a, b: np.searchsorted(places, b) - np.searchsorted(places, a)
    before_end = int(ended[0]) if row["depth"] >= 2 and len(ended) else None
    upto = before_end if before_end is not None else row["stop"]
    before = (int(count(commas, start, upto)), int(count(objects, start, upto))) if row["depth"] >= 2 else (0, 0)
    a, is_list = found.at[opened], found.mark[opened] == 91
    k = np.searchsorted(ended, a)
    whole = k < len(ended)
    b = np.where(whole, ended[np.minimum(k, len(ended) - 1)] if len(ended) else 0, row["stop"])
    n_commas, n_objects = count(commas, a, b), count(objects, a, b)
    good = np.flatnonzero(whole & is_list & (n_objects == n_commas + 1))
    span = (int(a[good[0]]), int(b[good[0]])) if len(good) else (None, None)
    tail = (int(a[-1]), bool(is_list[-1]), int(n_commas[-1]), int(n_objects[-1])) if len(a) and not whole[-1] else (None, None, 0, 0)
    yield _batch(_PLACES, [(row["path"], start, first, last, int(closed[0]) if len(closed) else None, *before, before_end, *span, *tail)])


def _shape(reports: pa.Table) -> pa.Table:
    """The shape of one document from its ranges' reports (a row per range), in order."""
    rows = sorted(reports.to_pylist(), key=lambda r: r["start"])
    path, last = rows[0]["path"], max((r["last"] for r in rows if r["last"] is not None), default=None)
    first = next((r["first"] for r in rows if r["first"] is not None), None)
    closed = min((r["closed"] for r in rows if r["closed"] is not None), default=None)
    out = lambda *shape: pa.Table.from_batches([_batch(_SHAPE, [(path, *shape)])])
    if last is None or first in "{[" and closed != last:
        return out("none", 0, None, None, last)
    if first not in "{[":
        return out("single", 0, None, None, last)
    if first == "[":
        return out("list", 1, None, closed, last)
    open_at, commas, objects = None, 0, 0  # a list of the first level that an earlier range opened
    for r in rows:
        if open_at is not None:
            commas, objects = commas + r["before_commas"], objects + r["before_objects"]
            if r["before_end"] is not None:
                if objects == commas + 1:
                    return out("list", 2, open_at, r["before_end"], last)
                open_at = None
        if r["list_start"] is not None:
            return out("list", 2, r["list_start"], r["list_end"], last)
        if r["open_start"] is not None:
            open_at, commas, objects = (r["open_start"] if r["open_is_list"] else None), r["open_commas"], r["open_objects"]
    return out("single", 0, None, None, last)


def _decoded(data: np.ndarray) -> str:
    return data.tobytes().decode("utf-8", "replace").strip(" \t\r\n")


def _text(file, start: int, stop: int) -> str:
    return _decoded(_read(file, start + 3 if start == 0 and _read(file, 0, 3).tobytes() == _BOM else start, stop))


def _records(file, row: dict) -> Iterator[pa.RecordBatch]:
    """The records that begin in a range, and (part "around") what stands around all records, with the first of them."""
    uri, start, stop = scan_uri(row["path"]), row["start"], row["stop"]
    if row["kind"] == "single":
        if start == 0:
            yield _batch(_UNITS, [(_text(file, 0, row["last"] + 1), uri, 0, 0, "record")])
        return
    end, begin = row["list_end"], row["list_start"]
    data = _read(file, start, stop)
    if begin is None:  # the document is the list; it begins with its first byte that is no blank or mark
        shown = np.flatnonzero(data == 91) if row["depth"] == 0 else []
        begin = int(shown[0]) + start if len(shown) else -1
    found = Scanned.of(data, start, _escaped(file, start), row["in_string"], row["depth"])
    level = row["level"]
    cuts = found.at[(found.mark == 44) & (found.depth == level) & (found.at > begin) & (found.at < end)]
    if start <= begin < stop:
        around = _text(file, 0, begin + 1) + _text(file, end, row["last"] + 1)
        yield _batch(_UNITS, [(around, uri, start, -1, "around")])
        cuts = np.concatenate([[begin], cuts])
    if not len(cuts):
        return
    stops = [*cuts[1:].tolist(), _next_cut(file, row, found, level)]
    held, size = [], 0
    for a, b in zip(cuts.tolist(), stops):
        unit = _text(file, a + 1, b) if b > stop else _decoded(data[a + 1 - start : b - start])
        if not unit and a == begin and b == end:
            continue  # an empty list
        held.append((unit, uri, start, a, "record"))
        size += len(unit)
        if size > UNIT_BYTES:
            yield _batch(_UNITS, held)
            held, size = [], 0
    if held:
        yield _batch(_UNITS, held)


def _next_cut(file, row: dict, found: Scanned, level: int) -> int:
    """The first end of a record behind a range: a comma of the list, or the list's end."""
    at, depth = row["stop"], int(found.depth[-1]) if len(found.depth) else row["depth"]
    if row["list_end"] < at:
        return row["list_end"]
    inside = row["next_in_string"]
    while at < row["list_end"]:
        data = _read(file, at, min(at + (1 << 16), row["list_end"]))
        escaped = _escaped(file, at)
        more = Scanned.of(data, at, escaped, inside, depth)
        cuts = more.at[(more.mark == 44) & (more.depth == level)]
        if len(cuts):
            return int(cuts[0])
        inside ^= bool(len(_quotes(data, escaped)) % 2)
        depth = int(more.depth[-1]) if len(more.depth) else depth
        at += len(data)
    return row["list_end"]


def document_units(spark: SparkSession, paths: list[str], work: str, size: int | None = None) -> tuple[DataFrame, list[str]]:
    """The records of large documents as ``(unit, uri, block, seq, part)``, and the paths that hold no single value by their
    brackets. ``seq`` is the place in front of a record. ``part`` "around" is a document without its records, which must be valid as well. Meant to be written at once:
    a lost task reads its range again."""
    size = size or RANGE_BYTES
    starts(ranges(spark, paths, size)).write.mode("overwrite").parquet(f"{work}/starts")
    begun = spark.read.parquet(f"{work}/starts")
    # A row per range: what meets here are reports of a file's ranges, not their bytes.
    shapes = _each(spread(begun, "path", "start"), _PLACES, _places).groupBy("path").applyInArrow(_shape, _SHAPE)
    shapes.write.mode("overwrite").parquet(f"{work}/shapes")
    shapes = spark.read.parquet(f"{work}/shapes")
    none = [r.path for r in shapes.where("kind = 'none'").select("path").collect()]
    following = F.lead("in_string").over(W.partitionBy("path").orderBy("start"))
    met = begun.withColumn("next_in_string", F.coalesce(following, F.lit(False))).join(
        shapes.where("kind <> 'none'").withColumnRenamed("depth", "level"), "path")
    return _each(spread(met, "path", "start"), _UNITS, _records), none
