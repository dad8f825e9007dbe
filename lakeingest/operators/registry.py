"""Purchase events and the registry they build.

Every rule here depends on at most two numbers per transaction: when it was first approved and when
it was last cancelled. Both are plain aggregates, combined before any shuffle, so neither the fold
nor the per-event outcome ever gathers the events of one transaction in one place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeingest.operators.skew import HOT_ROWS, join_skewed
from lakeingest.session import create_once, hadoop_path, read_small, remove_tree, work_folder

# Event names and registry words of the contract.
APPROVED = "PURCHASE_APPROVED"
REVOKING = ("PURCHASE_CANCELED", "PURCHASE_REFUNDED")
ACTIVE, REVOKED = "ativa", "revogada"
PERPETUAL, SUBSCRIPTION = "perpetua", "assinatura"

PAYLOAD = (
    "event string, data struct<buyer:struct<email:string>,purchase:struct<transaction:string>>, "
    "email string, transaction_id string, transaction string"
)
REGISTRY = (
    "id bigint, email string, hardware_id string, emitida_em string, expira_em string, tipo string, "
    "sha256_licenca string, status string, transaction_id string"
)


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract_events(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``event``, ``email`` and ``transaction_id``; flat keys stand in for missing nested ones."""
    p = F.from_json(payload, PAYLOAD)
    return (
        payloads.withColumn("p", p)
        .withColumn("event", F.upper("p.event"))
        .withColumn("email", F.coalesce(filled(F.col("p.data.buyer.email")), filled(F.col("p.email"))))
        .withColumn("transaction_id", F.coalesce(
            filled(F.col("p.data.purchase.transaction")),
            filled(F.col("p.transaction_id")), filled(F.col("p.transaction")),
        ))
        .drop("p")
    )


def authorized(events: DataFrame, expected: str, token: str = "token") -> DataFrame:
    """Events that carry the expected token; without an expected token nothing passes."""
    return events.where((F.col(token) == expected) & (F.lit(expected or "") != ""))


def is_approval(event="event", email="email", tx="transaction_id") -> Column:
    return (F.col(event) == APPROVED) & F.col(email).isNotNull() & F.col(tx).isNotNull()


def event_outcomes(
    spark: SparkSession, events: DataFrame, seq: str = "seq",
    hot_rows: int = HOT_ROWS, work: str | None = None,
) -> DataFrame:
    """Label every event with its ``outcome`` as sequential processing by ``seq`` would.

    The first approval per transaction comes from one pre-combined aggregate, written to the shared
    work folder. Transactions with very many events are few by arithmetic; their rows find it in a
    broadcast and then travel under random keys, so the join's shuffle stays even.
    """
    work = work or work_folder(spark, "registry")
    events.groupBy("transaction_id").agg(
        F.min(F.when(is_approval(), F.col(seq))).alias("first_seq"), F.count(F.lit(1)).alias("n")
    ).write.mode("overwrite").parquet(f"{work}/first")
    per_tx = spark.read.parquet(f"{work}/first")
    found = join_skewed(
        spark, events, per_tx.select("transaction_id", "first_seq"), per_tx, "transaction_id", seq, hot_rows
    )
    earlier = F.coalesce(F.col("first_seq") < F.col(seq), F.lit(False))
    event = F.coalesce("event", F.lit("None"))
    outcome = (
        F.when(F.col("transaction_id").isNull(), "missing_transaction_id")
        .when((event == APPROVED) & F.col("email").isNull(), "missing_email")
        .when((event == APPROVED) & earlier, "already_processed")
        .when(event == APPROVED, "success")
        .when(event.isin(*REVOKING) & earlier, "revoked")
        .when(event.isin(*REVOKING), "transaction_not_found")
        .otherwise(F.concat(F.lit("unhandled_event_"), event))
    )
    return found.withColumn("outcome", outcome).drop("first_seq")


def fold_aggregates(seq: str = "seq") -> list[Column]:
    """What a transaction's events amount to; associative, in batch and in a stream."""
    approval, at = is_approval(), F.col(seq)
    return [
        F.min(F.when(approval, at)).alias("approved_at"),
        F.max(F.when(F.col("event").isin(*REVOKING), at)).alias("revoked_at"),
        F.min_by("email", F.when(approval, at)).alias("email"),
    ]


def registry_rows(folded: DataFrame) -> DataFrame:
    """Registry entries of folded transactions: a revocation counts only after the approval."""
    status = F.when(F.col("revoked_at") > F.col("approved_at"), REVOKED).otherwise(ACTIVE)
    return folded.where("approved_at is not null").select(
        "transaction_id", "email", F.lit(PERPETUAL).alias("tipo"), status.alias("status"), "approved_at"
    )


def fold_registry(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Current registry from all events.

    Events without a transaction fold into one entry that is never approved, which drops it; a
    filter on the extracted key would be pushed below the extraction and repeat it.
    """
    return registry_rows(events.groupBy("transaction_id").agg(*fold_aggregates(seq)))


def lookup(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """Registry rows of the wanted transactions; a null transaction never matches."""
    return registry.join(keys.select("transaction_id").distinct(), "transaction_id", "left_semi")


def append_rows(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Append entries with ids that go on without gaps. Missing columns get their defaults.

    Writers do not wait for each other. The rows are written once with their place in their partition, so that
    ids follow from one count per partition and stay the same if a task runs again. With the ids behind the
    newest commit they go to a folder of their own, which counts only once the next numbered commit names it.
    That commit is made only where it is absent; who comes second takes the ids behind it and tries again.
    A writer that dies leaves files that nothing names. ``read_registry`` reads what is committed.
    """
    staged = work_folder(spark, "append")
    try:
        rows = with_defaults(rows).drop("id")
        place = F.monotonically_increasing_id()
        rows.select(*rows.columns, F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_at")).write.parquet(staged)
        placed = spark.read.parquet(staged)
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
        n_rows = placed.count()
        while True:
            newest = max(commits(spark, folder), key=lambda c: c["number"], default=None)
            last = newest["last"] if newest else _last_loose_id(spark, folder)
            data = f"_dados/{uuid.uuid4().hex}"
            placed.join(starts, "_part").select(
                (F.col("_start") + F.col("_at") + last + 1).alias("id"), *rows.columns).write.parquet(f"{folder}/{data}")
            number = newest["number"] + 1 if newest else 1
            said = json.dumps({"number": number, "last": last + n_rows, "data": data})
            if create_once(spark, f"{folder}/_commits/{number:020d}.json", said):
                return
            remove_tree(spark, f"{folder}/{data}")
    finally:
        remove_tree(spark, staged)


def commits(spark: SparkSession, folder: str) -> list[dict]:
    """The commits of a registry, one small file each: ``number``, ``last`` id and the folder of its ``data``."""
    return [json.loads(text) for text in read_small(spark, f"{folder}/_commits", ".json")]


def _loose_files(spark: SparkSession, folder: str) -> bool:
    """Whether the folder holds entries that were written before there were commits."""
    fs, path = hadoop_path(spark, folder)
    return fs.exists(path) and any(not e.getPath().getName().startswith(("_", ".")) for e in fs.listStatus(path))


def _last_loose_id(spark: SparkSession, folder: str) -> int:
    if not _loose_files(spark, folder):
        return 0
    return spark.read.option("recursiveFileLookup", True).parquet(folder).agg(F.max("id")).first()[0] or 0


def with_defaults(rows: DataFrame) -> DataFrame:
    """Registry rows in the current schema; entries from before ``status`` existed are active."""
    known = set(rows.columns)
    cols = []
    for part in REGISTRY.split(", "):
        name, kind = part.split(" ")
        c = F.col(name).cast(kind) if name in known else F.lit(None).cast(kind)
        cols.append((F.coalesce(c, F.lit(ACTIVE)) if name == "status" else c).alias(name))
    return rows.select(*cols)


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Registry files of all generations under one schema: loose files, and the folders that commits name."""
    paths = [f"{folder}/{c['data']}" for c in commits(spark, folder)]
    if not paths or _loose_files(spark, folder):
        paths.append(folder)
    return with_defaults(spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths))


def expiry(tipo: Column, validade: Column) -> Column:
    """``struct<expira_em, erro>``: a date ends with its day; a subscription needs one."""
    given = filled(validade)
    day = F.when(given.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(given, "yyyy-MM-dd"))
    end = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59Z"))
    error = (
        F.when((tipo == SUBSCRIPTION) & given.isNull(), "assinatura exige data de validade")
        .when(given.isNotNull() & day.isNull(), "data de validade inválida")
    )
    return F.struct(F.when(error.isNull(), end).alias("expira_em"), error.alias("erro"))


def validity(expira_em: Column, bound_to: Column, hardware_id: Column, as_of: Column) -> Column:
    """``valid``, ``invalid_date``, ``expired`` or ``other_hardware``; valid on the last day itself."""
    given, bound = filled(expira_em), filled(bound_to)
    day = F.when(
        F.substr(given, F.lit(1), F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"),
        F.try_to_date(F.substr(given, F.lit(1), F.lit(10)), "yyyy-MM-dd"),
    )
    return (
        F.when(given.isNotNull() & day.isNull(), "invalid_date")
        .when(as_of > day, "expired")
        .when(bound.isNotNull() & ~F.coalesce(F.upper(bound) == F.upper(hardware_id), F.lit(False)), "other_hardware")
        .otherwise("valid")
    )


def audit_validity(
    spark: SparkSession, registry: DataFrame, activations: DataFrame, as_of: Column,
    hot_rows: int = HOT_ROWS, work: str | None = None,
) -> DataFrame:
    """Validity of every activation of a registered transaction (joined on ``transaction_id``).

    One licence may account for most activations, so the join treats frequent keys apart.
    """
    work = work or work_folder(spark, "validity")
    activations.where("transaction_id is not null").groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("n")
    ).write.mode("overwrite").parquet(f"{work}/counts")
    counts = spark.read.parquet(f"{work}/counts")
    entries = registry.select(
        "transaction_id", "expira_em", F.col("hardware_id").alias("bound_to"), F.lit(True).alias("registered")
    )
    joined = join_skewed(spark, activations, entries, counts, "transaction_id", "hardware_id", hot_rows)
    return joined.where("registered").withColumn(
        "validity", validity(F.col("expira_em"), F.col("bound_to"), F.col("hardware_id"), as_of)
    ).drop("registered")
