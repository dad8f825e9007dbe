"""Listing, validating and sniffing of source files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.functions import files as ff
from lakeingest.options import SUPPORTED_FORMATS
from lakeingest.session import qualified
from lakeingest.sources.remote import list_tree, read_heads, scan_uri


def list_files(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """All files below the roots as ``(path, uri, length)``; missing roots are skipped.

    No file content is read. ``uri`` is the escaped form under which a scan reports its rows' file.
    """
    present = [(q,) for r in dict.fromkeys(roots) if (q := qualified(spark, r))]
    return list_tree(spark.createDataFrame(present, "path string"))


def given_sources(files: DataFrame) -> DataFrame:
    """Supported files of a table ``(path, length)`` that another listing made: none of them is looked up again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(uri=[scan_uri(p) for p in batch["path"]])

    known = files.select("path", F.col("length").cast("bigint").alias("length")).where("path is not null").dropDuplicates(["path"])
    known = known.withColumn("format", ff.detect_format(F.col("path"))).where("format is not null")
    return known.mapInPandas(run, "path string, length bigint, format string, uri string").select("path", "uri", "length", "format")


def list_sources(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """Supported files, once each, with their format; sorting is left to the consumer."""
    listed = list_files(spark, roots).dropDuplicates(["path"])
    return listed.withColumn("format", ff.detect_format(F.col("path"))).where("format is not null")


def validation_error(path: Column, length: Column, is_folder: Column, read_error: Column) -> Column:
    """The first validation rule a file breaks, else null. A null length means: not found."""
    shown = lambda text: F.concat(F.lit(text), path)
    return (
        F.when(length.isNull(), shown("Arquivo não encontrado: "))
        .when(is_folder, shown("O caminho não é um arquivo: "))
        .when(
            ff.detect_format(path).isNull(),
            F.concat(
                F.lit("Formato não suportado: ."), ff.file_extension(path),
                F.lit(f" (aceitos: {', '.join(SUPPORTED_FORMATS)})"),
            ),
        )
        .when(path.rlike(r"/[_.][^/]*$"), shown("Nome reservado (inicia com _ ou .): "))
        .when(length == 0, shown("Arquivo vazio (0 bytes): "))
        .when(read_error.isNotNull(), shown("Sem permissão de leitura: "))
    )


def validate_sources(expected: DataFrame, listed: DataFrame) -> DataFrame:
    """Validation message for every expected path (column ``path``), found in the listing or not.

    A path that only occurs as the folder of listed files is no file. Both sides may be large, so
    the join strategy is left to the optimizer.
    """
    found = listed.select("path", "length", F.lit(False).alias("is_folder")).dropDuplicates(["path"])
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = listed.select(F.explode(above).alias("path")).distinct().select(
        "path", F.lit(-1).cast("bigint").alias("length"), F.lit(True).alias("is_folder")
    )
    joined = expected.select("path").join(found.unionByName(folders), "path", "left")
    error = validation_error(
        F.col("path"), F.col("length"), F.coalesce("is_folder", F.lit(False)), F.lit(None).cast("string")
    )
    return joined.withColumn("erro", error)


def sniff(listed: DataFrame) -> DataFrame:
    """Physical properties of every supported file, from one read of its head.

    Adds ``encoding``, ``sep`` and ``layout``: the raw header of a delimited file or the key list
    of a JSON source. ``text`` is the decoded head.
    """
    is_csv, is_json = F.col("format") == "csv", F.col("format").isin("json", "ndjson", "jsonl")
    longer = ff.decode_head(F.concat("head", "header_rest"), F.col("encoding"))
    whole = F.when(F.octet_length("header_rest") > 0, longer).otherwise(F.col("text"))
    return (
        read_heads(listed)
        .withColumn("encoding", F.when(is_csv, ff.detect_encoding(F.col("head"))))
        .withColumn(
            "text",
            F.when(is_csv, ff.decode_head(F.col("head"), F.col("encoding"))).when(
                is_json, F.make_valid_utf8(F.col("head").cast("string"))
            ),
        )
        .withColumn("sep", F.when(is_csv, ff.sniff_delimiter(F.col("text"))))
        .withColumn(
            "layout",
            F.when(is_csv, ff.header_record(whole)).when(is_json, ff.key_layout(F.col("text"))),
        )
        .withColumn(
            "erro",
            validation_error(F.col("path"), F.col("length"), F.lit(False), F.col("read_error")),
        )
    )
