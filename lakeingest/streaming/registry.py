"""The registry kept current by a stream of purchase events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeingest.operators.registry import extract_events, fold_aggregates, registry_rows
from lakeingest.session import hadoop_path, remove_tree


SNAPSHOTS = "_retrato"
_STATE = "approved_at", "revoked_at", "email"


def stream_registry(
    events: DataFrame, out: str, checkpoint: str, seq: str = "seq", share: float = 0.5
) -> StreamingQuery:
    """Fold a stream of ``(seq, payload)`` and write the changed transactions of every batch.

    There is no watermark, because a refund may arrive at any time: state is two numbers and an
    address per transaction. A repeated batch overwrites its own folder. Once the changes since the
    last snapshot exceed ``share`` of its bytes they are merged into the next one.
    """
    folded = (
        extract_events(events)
        .groupBy("transaction_id").agg(*fold_aggregates(seq))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/lote={batch_id}")
        merge_changes(batch.sparkSession, out, share)

    return (
        folded.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _numbered(spark: SparkSession, folder: str, complete: bool = False) -> dict[int, int]:
    """Bytes of every ``lote=<n>`` folder; with ``complete`` only of those whose write was finished."""
    fs, path = hadoop_path(spark, folder)
    found = {}
    for entry in fs.listStatus(path) if fs.exists(path) else ():
        name = entry.getPath().getName()
        if name.startswith("lote=") and not (complete and not fs.exists(hadoop_path(spark, f"{folder}/{name}/_SUCCESS")[1])):
            found[int(name[5:])] = fs.getContentSummary(entry.getPath()).getLength()
    return found


def _newest(spark: SparkSession, out: str, snapshot: int | None, batches: list[int]) -> DataFrame:
    """The last change of every transaction, with the batch it came from."""
    parts = []
    if snapshot is not None:
        parts.append(spark.read.parquet(f"{out}/{SNAPSHOTS}/lote={snapshot}"))
    if batches or not parts:
        folders = [f"{out}/lote={n}" for n in batches] or [out]
        parts.append(spark.read.option("basePath", out).parquet(*folders).withColumn("lote", F.col("lote").cast("bigint")))
    changes = reduce(DataFrame.unionByName, parts)
    newest = changes.groupBy("transaction_id").agg(F.max_by(F.struct("lote", *_STATE), "lote").alias("now"))
    return newest.select("transaction_id", "now.*")


def _parts(spark: SparkSession, out: str) -> tuple[int | None, list[int], dict[int, int], dict[int, int]]:
    snapshots, batches = _numbered(spark, f"{out}/{SNAPSHOTS}", complete=True), _numbered(spark, out)
    last = max(snapshots, default=None)
    return last, sorted(n for n in batches if last is None or n > last), snapshots, batches


def merge_changes(spark: SparkSession, out: str, share: float) -> bool:
    """Write the next snapshot if the changes behind the last one exceed ``share`` of it.

    A snapshot counts once its write is complete. What it replaces stays for readers that have begun, until
    the snapshot after it is there; so folders and bytes that a reader meets do not grow with the batches.
    """
    last, behind, snapshots, batches = _parts(spark, out)
    held = snapshots.get(last, 0)
    if not behind or sum(batches[n] for n in behind) <= share * held:
        return False
    folder = f"{out}/{SNAPSHOTS}/lote={behind[-1]}"
    _newest(spark, out, last, behind).write.mode("overwrite").parquet(folder)
    if last is not None:
        for n in batches:
            if n <= last:
                remove_tree(spark, f"{out}/lote={n}")
        for n in snapshots:
            if n < last:
                remove_tree(spark, f"{out}/{SNAPSHOTS}/lote={n}")
    return True


def current_registry(spark: SparkSession, out: str) -> DataFrame:
    """Registry after the last batch: the last snapshot and the changes behind it."""
    last, behind, _, _ = _parts(spark, out)
    return registry_rows(_newest(spark, out, last, behind))
