"""Source files made from the given tables, for the registered queries and the benchmark.

Everything is written by Spark tasks below the shared work folder, a file per partition or per
fixed-size block of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakeingest.session import small_batches, work_folder
from lakeingest.sources.remote import resolve, write_bytes

PIECE_ROWS = 500  # of a batch, that are joined and encoded at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_lines(
    df: DataFrame, folder: str, ext: str, header: str | None = None, encoding: str = "utf-8"
) -> str:
    """Write column ``value`` as text files, one per partition with rows; a retried task rewrites its file.

    A scan may leave partitions without rows, whose files a run would have to report as empty. Only where no
    partition has a row, one file holds the header alone.
    """
    head = b"" if header is None else f"{header}\n".encode(encoding)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = resolve(folder)
        fs.create_dir(base, recursive=True)
        out, rows = None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                values = batch.column(0).slice(start, PIECE_ROWS).to_pylist()
                if out is None:
                    out = fs.open_output_stream(f"{base}/part-{TaskContext.get().partitionId():05d}.{ext}")
                    out.write(head)
                out.write(("\n".join(values) + "\n").encode(encoding, errors="replace"))
            rows += batch.num_rows
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array([rows], pa.int64())], names=["n"])

    with small_batches(df.sparkSession):
        written = df.select("value").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0]
    if not written:
        write_bytes(f"{folder}/part-00000.{ext}", head)
    return folder


def write_files(df: DataFrame, folder: str) -> str:
    """Write one file per row from ``(name, content)``.

    Rows are handed to Python in batches of some MB; Arrow's go by rows, which may be files of any size.
    """

    def write(rows: Iterator[Row]) -> None:
        for name, content in rows:
            write_bytes(f"{folder}/{name}", bytes(content))

    df.select("name", F.col("content").cast("binary").alias("content")).rdd.foreachPartition(write)
    return folder


def blocks(df: DataFrame, key: str, size: int, sep: str = "\n") -> DataFrame:
    """``(bloco, body)``: column ``value`` of every ``size`` consecutive keys, joined in key order.

    A block holds at most ``size`` rows because keys are unique.
    """
    block = F.floor(F.col(key) / size).cast("bigint").alias("bloco")
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "value")))
    return df.groupBy(block).agg(F.array_join(F.transform(rows, lambda r: r["value"]), sep).alias("body"))


def write_blocks(df: DataFrame, key: str, size: int, name: str, folder: str) -> str:
    """Write what ``blocks`` gives as a file per block, whose number ``name`` formats.

    Rows are sorted and streamed to their files, so that no task holds a block, however long its lines are.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = resolve(folder)
        fs.create_dir(base, recursive=True)
        out, current, empty, rows = None, None, True, 0
        for batch in batches:
            for file, some in groupby(zip(*(c.to_pylist() for c in batch.columns)), itemgetter(0)):
                if file != current:
                    if out is not None:
                        out.close()
                    out, current, empty = fs.open_output_stream(f"{base}/{file}"), file, True
                lines = [value for _, value in some if value is not None]
                if lines:
                    out.write((b"" if empty else b"\n") + b"\n".join(lines))
                    empty = False
            rows += batch.num_rows
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array([rows], pa.int64())], names=["n"])

    block = F.floor(F.col(key) / size).cast("bigint").alias("bloco")
    sorted_rows = df.select(block, F.col(key).alias("k"), "value").repartition("bloco").sortWithinPartitions("bloco", "k", "value")
    with small_batches(df.sparkSession):
        sorted_rows.select(F.format_string(name, "bloco").alias("name"), F.col("value").cast("binary")).mapInArrow(write, "n bigint").agg(F.sum("n")).first()
    return folder


def fresh(spark: SparkSession, label: str) -> str:
    return work_folder(spark, label)
