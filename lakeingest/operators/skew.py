"""A left join that stays even when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000
MAX_HOT_KEYS = 100_000
SALTS = 4096


def join_skewed(
    spark: SparkSession, big: DataFrame, small: DataFrame, counts: DataFrame, key: str,
    spread_by: str, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach the columns of ``small`` (one row per ``key``) to ``big``; no match leaves nulls.

    ``counts`` holds ``(key, n)``, the rows per key in ``big``. Keys with at least ``hot_rows`` rows
    are few by arithmetic; their entries are broadcast, and their rows, like those without a key,
    travel under random keys that match nothing. The shuffle sees only ordinary keys.
    """
    # The broadcast is bounded: raise the bar until few enough keys are hot.
    while counts.where(F.col("n") >= hot_rows).limit(MAX_HOT_KEYS + 1).count() > MAX_HOT_KEYS:
        hot_rows *= 10
    names = [c for c in small.columns if c != key]
    tagged = small.join(counts.select(key, "n"), key)
    hot = tagged.where(F.col("n") >= hot_rows).select(
        F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot")
    )
    cold = tagged.where(F.col("n") < hot_rows).select(
        F.col(key).alias("_cold_key"), F.struct(*names).alias("_cold")
    )
    random_key = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("string"))
    alone = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    return (
        big.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_key", F.when(alone, random_key).otherwise(F.col(key)))
        .join(cold, F.col("_key") == F.col("_cold_key"), "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
        .select(*big.columns, *[F.col("_found")[c].alias(c) for c in names])
    )
