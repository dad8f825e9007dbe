"""A folder that keeps receiving files, ingested once each by a checkpointed stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeingest.functions.files import detect_format
from lakeingest.options import IngestOptions
from lakeingest.plans.ingest import ingest

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_folder(
    spark: SparkSession, folder: str, out: str, checkpoint: str,
    opts: IngestOptions = IngestOptions(), files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Start ingesting the new files of ``folder`` and stop when none is left.

    The source log remembers which files were taken. Only their paths and lengths flow through the stream, which
    listed them already: they are not looked up again. The content is read by the ingestion run of the micro-batch, which overwrites its own folders, so
    a repeated batch leaves no duplicates. Empty files carry no rows and are not seen.
    """
    files = (
        spark.readStream.format("binaryFile").schema(_FILES)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path", "length")
        .where(detect_format(F.col("path")).isNotNull())
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            ingest(batch.sparkSession, batch, out, opts, run=f"{batch_id:06d}")

    return (
        files.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
