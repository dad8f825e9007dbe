"""Splittable line scans that still know each line's number in its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeingest.session import few_tasks, literal_path


def read_lines(spark: SparkSession, paths: list[str], line_sep: str | None = None) -> DataFrame:
    """``(value, uri, block, seq)`` of every line.

    ``block`` is the byte offset at which the line's split begins and ``seq`` rises by one from
    line to line inside a split, so neither a shuffle nor a single task is needed to order lines. Small
    splits share tasks.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    files = reader.text([literal_path(p) for p in paths])
    return few_tasks(files.select(
        "value",
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    ), files)


def block_table(lines: DataFrame, *more) -> DataFrame:
    """One row per split: its first ``seq``, and the lines before it in the file (``before``).

    The aggregate is combined map-side to one row per split; the window then runs over splits.
    """
    order = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        lines.groupBy("uri", "block")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.min("seq").alias("first_seq"), *more)
        .withColumn("before", F.coalesce(F.sum("n_lines").over(order), F.lit(0)))
    )


def number_lines(some: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add the 1-based physical ``line_number`` to a subset of the lines.

    The split table is joined without a hint: it has one row per 128 MB of data, and the engine
    broadcasts it only while its measured size allows. A line whose split is unknown means the two
    scans were cut differently, which must not pass silently.
    """
    joined = some.join(blocks.select("uri", "block", "first_seq", "before"), ["uri", "block"], "left")
    number = F.when(
        F.col("before").isNotNull(), F.col("before") + F.col("seq") - F.col("first_seq") + 1
    ).otherwise(F.raise_error(F.lit("source splits changed between scans")).cast("bigint"))
    return joined.withColumn("line_number", number).drop("first_seq", "before")
