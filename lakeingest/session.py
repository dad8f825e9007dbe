"""Session helpers: the isolated session ingestion runs in, and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Of rows that a task hands to Python at once: it holds a few batches, however long their rows are.
BATCH_BYTES = 2 << 20
#: Of files that a task scans at least, where they are many.
TASK_BYTES = 16 << 20
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def isolated(spark: SparkSession) -> SparkSession:
    """A sibling session with the settings ingestion relies on.

    It shares the executors and the caller's SQL settings, so nothing leaks into the caller's
    session. ``minPartitionNum`` is pinned because two scans of one file must be split alike
    even when executors come and go in between (see ``sources.lines``).
    """
    inner = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and inner.conf.isModifiable(key):
            inner.conf.set(key, value)
    inner.conf.set("spark.sql.caseSensitive", "true")
    inner.conf.set("spark.sql.ansi.enabled", "true")
    inner.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    inner.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # A task keeps this many source datasets open before it has to sort its rows by source.
    inner.conf.set("spark.sql.maxConcurrentOutputFileWriters", "32")
    # Folders of a dataset are listed by some tasks per core; the default is a task per folder.
    inner.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    if inner.conf.get("spark.sql.files.minPartitionNum", None) is None:
        inner.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return inner


@contextmanager
def _setting(spark: SparkSession, key: str, value) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """Actions inside hand rows to Python in batches of some MB, whatever the length of a row; the default goes by rows."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def few_listings(spark: SparkSession):
    """Datasets read inside have their folders listed by some tasks per core; the default is a task per folder."""
    return _setting(spark, LISTING, str(4 * spark.sparkContext.defaultParallelism))


def few_tasks(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of a scan of ``files``, whose splits share tasks of some MB; the splits themselves stay as they are.

    Small files or splits otherwise make a task each, and as many output files and records of the driver. Nothing is
    shuffled, and no task is added.
    """
    size = files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.coalesce(max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder of the cluster (``spark.checkpoint.dir``)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lakeingest-")
    return f"{shared.rstrip('/')}/lakeingest/{label}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows that each stand for a lot of work, such as files to open.

    The number is explicit because adaptive execution would merge such small rows into one task.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def literal_path(path: str) -> str:
    """Escape glob characters, so that ``notas [1].csv`` names one file."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def hadoop_path(spark: SparkSession, path: str):
    """``(filesystem, path)`` of the cluster's file API."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def qualified(spark: SparkSession, path: str) -> str | None:
    """The path with its file system, or null when nothing exists there."""
    fs, jpath = hadoop_path(spark, path)
    return fs.makeQualified(jpath).toString() if fs.exists(jpath) else None


def remove_tree(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_path(spark, path)
    if fs.exists(jpath):
        fs.delete(jpath, True)


def move_tree(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another name, in place of what had it."""
    fs, jpath = hadoop_path(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(jpath, target):
        raise OSError(f"cannot rename {path}")


def partition_folder(spark: SparkSession, path: str) -> str:
    """The folder of a partition whose path ends in ``column=value``, as the writer escapes the value."""
    parent, _, last = path.rpartition("/")
    column, _, value = last.partition("=")
    return f"{parent}/{column}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}"


def has_data(spark: SparkSession, folder: str) -> bool:
    """Whether a partitioned dataset folder holds any partition."""
    fs, jpath = hadoop_path(spark, folder)
    if not fs.exists(jpath):
        return False
    entries = fs.listStatusIterator(jpath)
    while entries.hasNext():
        if entries.next().isDirectory():
            return True
    return False


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its content unless it exists; false where another writer was first.

    The content is written beside it and then given the name in one step, which a reader never sees half done:
    a link on a local file system, elsewhere a rename that does not overwrite (atomic on HDFS and its like).
    """
    fs, target = hadoop_path(spark, path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    draft = jvm_path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            plain = [fs.makeQualified(p).toUri().getPath() for p in (draft, target)]
            os.link(*plain)
        else:
            options = spark._jvm.org.apache.hadoop.fs.Options
            never = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 0)
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(draft, target, never)
        return True
    except Exception:
        if not fs.exists(target):
            raise
        return False
    finally:
        fs.delete(draft, False)


def read_small(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """The texts of a folder's small files, by name."""
    fs, jpath = hadoop_path(spark, folder)
    if not fs.exists(jpath):
        return []
    found = [e.getPath() for e in fs.listStatus(jpath) if e.getPath().getName().endswith(suffix)]
    texts = []
    for path in sorted(found, key=lambda p: p.getName()):
        stream = fs.open(path)
        texts.append(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    return texts
