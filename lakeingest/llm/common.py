"""Helpers of the operators: whole tables, Arrow mapping, and intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.session import remove_tree, work_folder

#: Rows that a mapping function gets at once; long texts make smaller pieces (``by_bytes``).
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table below the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    folder = work_folder(spark, f"llm-{label}")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def drop_stored(spark: SparkSession, folder: str) -> None:
    remove_tree(spark, folder)


def text_of(name: str = "text"):
    """The text column as a string, null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``limit`` bytes of ``column`` (a single row may be larger)."""
    for batch in batches:
        start, rows = 0, batch.num_rows
        if batch.column(batch.schema.get_field_index(column)).nbytes <= limit:
            if rows:
                yield batch
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        held = 0
        for i, size in enumerate(sizes):
            if held and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < rows:
            yield batch.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str) -> DataFrame:
    """``mapInArrow`` over pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in by_bytes(batches, column):
            yield fn(piece)

    return df.mapInArrow(run, schema)


def frequent(counts: DataFrame, most: int) -> dict:
    """The counts ``{word: c}`` of the most frequent words of ``(word, c)``: all from some count on, at most ``most``."""
    level = F.floor(16 * F.log2("c")).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = None, 0
    for k in sorted(sizes, reverse=True):  # some hundred levels at most
        held += sizes[k]
        if held > most:
            break
        least = k
    if least is None:
        return {}
    return {w: c for w, c in counts.where(level >= least).select("word", "c").collect()}
