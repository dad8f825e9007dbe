"""What every reader shares: the layout being read, its columns, and the write of a layout."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeingest.functions import names as nm
from lakeingest.functions.files import base_name
from lakeingest.functions.values import coordinate_value
from lakeingest.options import IngestOptions

# Accepted codec names; anything else is written as snappy.
CODECS = {"snappy": "snappy", "zstd": "zstd", "none": "uncompressed"}
# Colliding base names are spelled out in the plan up to this many, beyond it they are a table to join.
MAX_LISTED_COLLISIONS = 500
# The partition column of the datasets; see ``free_name``.
SOURCE = "lake_source"
NAME_DIGITS = 32
# Characters that Spark escapes in the names of partition folders.
_ESCAPED = r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""


@dataclass
class Layout:
    """Files that one scan can read: same format, encoding, delimiter and header."""

    id: str
    format: str
    paths: list[str]
    encoding: str | None = None
    sep: str | None = None
    header: str | None = None
    sample: str = ""
    truncated: bool = False


@dataclass
class Outcome:
    """What became of a layout: where it was written and which of its files failed."""

    layout: str
    folder: str | None = None
    original: list[str] = field(default_factory=list)
    final: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    failed: DataFrame | None = None  # (uri, erro)
    invalid: DataFrame | None = None  # (uri, line_number, content, error)
    sheets: bool = False

    @property
    def source(self) -> str:
        """The partition column of the folder's datasets."""
        return free_name(self.final)

    @property
    def of_layout(self) -> str:
        """The layout whose files were read; groups of its files add a number to its id."""
        return self.layout.split("-")[0]


def plain_uri(uri: Column) -> Column:
    """Readable path of an escaped file URI."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def sheet_uri(uri: Column, dataset: Column) -> Column:
    """The URI of a file, with the sheet's name behind ``#``, which an escaped URI holds nowhere else."""
    return F.when(dataset == "", uri).otherwise(F.concat(uri, F.lit("#"), dataset))


def source_base(uri: Column) -> Column:
    """Base name of a source's file. This runs for every row, so it cuts the name at its last dot without
    a pattern and decodes only names that are escaped."""
    last = F.substring_index(F.substring_index(uri, "#", 1), "/", -1)
    last = F.when(last.contains("%"), plain_uri(last)).otherwise(last)
    return F.left(last, F.length(last) - F.length(F.substring_index(last, ".", -1)) - 1)


def dataset_name(base: Column, path: Column, shared: Column, sheet: Column | None = None) -> Column:
    """Dataset name of a source: base name and sheet, with a hash of the plain path where others share the base."""
    base = base if sheet is None else F.concat(base, sheet)
    hashed = F.concat(base, F.lit("__"), F.substr(F.sha2(path, 256), F.lit(1), F.lit(NAME_DIGITS)))
    return F.concat(F.when(shared, hashed).otherwise(base), F.lit(".parquet"))


def named(df: DataFrame, uri: Column, colliding: Sequence[tuple] | DataFrame, out: str = SOURCE) -> DataFrame:
    """Add the dataset name of every row's source.

    ``colliding`` holds the shared base names, each with the path that keeps the plain name or null: a list, or
    a stored table ``(base, keeper)`` where they are too many to spell out. The table is joined without a hint,
    so Spark broadcasts it only while it is small.
    """
    base, path = source_base(uri), plain_uri(F.substring_index(uri, "#", 1))
    sheet = F.when(uri.contains("#"), F.concat(F.lit("__"), F.substring_index(uri, "#", -1))).otherwise("")
    if isinstance(colliding, DataFrame):
        hits = colliding.select(F.col("base").alias("_base"), F.col("keeper").alias("_keeper"), F.lit(True).alias("_shared"))
        met = df.withColumn("_base", base).join(hits, "_base", "left")
        shared = F.col("_shared").isNotNull() & ~path.eqNullSafe(F.col("_keeper"))
        return met.withColumn(out, dataset_name(F.col("_base"), path, shared, sheet)).drop("_base", "_keeper", "_shared")
    shared = F.lit(False)
    if colliding:
        shared = base.isin([b for b, _ in colliding]) & ~path.isin([k for _, k in colliding if k is not None])
    return df.withColumn(out, dataset_name(base, path, shared, sheet))


def colliding_names(files: DataFrame, folder: str, keep_last: bool = False) -> list[tuple] | DataFrame:
    """Base names of more than one path (of files ``path, uri``), and with ``keep_last`` the last path of each:
    a list of ``(base, keeper)`` while short, else a stored table."""
    keeper = F.max_by(plain_uri(F.col("uri")), "path") if keep_last else F.lit(None).cast("string")
    names = files.groupBy(source_base(F.col("uri")).alias("base")).agg(F.count(F.lit(1)).alias("n"), keeper.alias("keeper"))
    names.where("n > 1").select("base", "keeper").write.mode("overwrite").parquet(folder)
    shared = files.sparkSession.read.schema("base string, keeper string").parquet(folder)
    first = [(r.base, r.keeper) for r in shared.limit(MAX_LISTED_COLLISIONS + 1).collect()]
    return first if len(first) <= MAX_LISTED_COLLISIONS else shared


def finish_columns(df: DataFrame, original: Sequence[str], opts: IngestOptions):
    """Rename, then cast coordinate text; ``df`` holds the data columns by position, then ``uri``.

    Returns the frame with its final names and the final names. Coordinates are matched on final
    names, identifier columns were already fixed on the original ones.
    """
    if opts.normalize:
        final = nm.normalize_names(original)[0]
    else:
        final = list(original) if all(original) else nm.unique_names([n or nm.UNNAMED for n in original])
    fields = df.schema.fields[: len(original)]
    cols = []
    for f, name in zip(fields, final):
        c = F.col(f.name)
        if opts.casts_coordinates and isinstance(f.dataType, T.StringType) and nm.is_coordinate(name):
            c = coordinate_value(c)
        cols.append(c.alias(name))
    return df.select(*cols, "uri"), final


def write_parquet(df: DataFrame, folder: str, compression: str, partition: Sequence[str] = ()) -> None:
    codec = CODECS.get(str(compression).lower(), "snappy")
    writer = df.write.mode("overwrite").option("compression", codec)
    # Tasks move their own files into place; the driver would move those of all sources one by one.
    writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    (writer.partitionBy(*partition) if partition else writer).parquet(folder)


def write_layout(df: DataFrame, folder: str, opts: IngestOptions, colliding) -> dict[str, str]:
    """Write a finished frame as one dataset per source below ``folder``; returns its types.

    Rows of a source are already together in their tasks, so there is no shuffle; the session
    lets a task keep several writers open instead of sorting its rows by source.
    """
    types = {f.name: type_label(f.dataType) for f in df.schema.fields if f.name != "uri"}
    source = free_name(types)
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in types]
    write_parquet(named(df, F.col("uri"), colliding, source).select(*quoted, source), folder, opts.compression, [source])
    return types


def escaped_partition(path: Column) -> Column:
    """The folder of a partition whose path ends in ``column=value``, as the writer escapes the value."""
    last = F.substring_index(path, "/", -1)
    value = F.substr(last, F.locate("=", last) + 1)
    escaped = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(
        c.rlike(_ESCAPED), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.concat(F.left(path, F.length(path) - F.length(value)), F.when(value.rlike(_ESCAPED), escaped).otherwise(value))


def free_name(taken) -> str:
    """The partition column's name, lengthened where a source has a column of that name."""
    name, low = SOURCE, {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def type_label(t: T.DataType) -> str:
    """Reported type name."""
    if isinstance(t, T.ArrayType):
        return f"List({type_label(t.elementType)})"
    if isinstance(t, T.StructType):
        return "Struct({" + ", ".join(f"'{f.name}': {type_label(f.dataType)}" for f in t.fields) + "})"
    return {
        "bigint": "Int64", "double": "Float64", "string": "String", "boolean": "Boolean",
        "date": "Date", "timestamp_ntz": "Datetime", "int": "Int32",
    }.get(t.simpleString(), t.simpleString())


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Attach metrics that are read back once the frame has been written."""
    watch = Observation()
    return df.observe(watch, *[c.alias(k) for k, c in metrics.items()]), watch


def output_names(files: DataFrame, collision: str = "hash") -> DataFrame:
    """Dataset name of every path (column ``path``), and whether its data survives the run.

    Sources that share a base name get a path hash each, or with ``overwrite`` one name that the
    last path keeps. The count per base name is combined before the shuffle, so a very common
    base name stays one small row.
    """
    based = files.select("path").distinct().withColumn("base", base_name(F.col("path")))
    stats = based.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("last"))
    met = based.join(stats, "base")
    overwrite = collision == "overwrite"
    shared = F.lit(False) if overwrite else F.col("n") > 1
    kept = F.col("path") == F.col("last") if overwrite else F.lit(True)
    return met.select("path", dataset_name(F.col("base"), F.col("path"), shared).alias("dataset"), kept.alias("kept"))
