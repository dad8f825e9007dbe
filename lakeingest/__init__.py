"""Auditable bulk ingestion of CSV, JSON, NDJSON and Excel files into Parquet, on Spark."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from lakeingest.options import IngestOptions  # noqa: E402
from lakeingest.plans.ingest import IngestResult, ingest  # noqa: E402

__all__ = ["IngestOptions", "IngestResult", "ingest"]
