"""Queries on purchase events and the registry."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.catalog.samples import fresh, table
from lakeingest.operators import registry as rg
from lakeingest.streaming.registry import current_registry, stream_registry

TOKEN = "segredo"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as purchase payloads ``(seq, token, payload)``.

    Event types become event names, user ids transactions; where a key sits in the document varies
    with the event type.
    """
    e = table(spark, sf_dir, "events")
    kind, tx = F.col("event_type"), F.col("user_id").cast("string")
    email = F.concat(F.lit("u"), tx, F.lit("-"), F.col("event_id").cast("string"), F.lit("@x.org"))
    name = (
        F.when(kind == "purchase", "purchase_approved").when(kind == "click", "PURCHASE_APPROVED")
        .when(kind == "error", "PURCHASE_REFUNDED").when(kind == "signup", "Purchase_Canceled").otherwise(kind)
    )
    nested = F.struct(
        F.struct(F.when(kind == "purchase", email).otherwise("").alias("email")).alias("buyer"),
        F.struct(F.when(kind.isin("purchase", "error"), tx).alias("transaction")).alias("purchase"),
    )
    flat = F.when((kind == "click") & (F.col("value") > 10), tx)
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(kind == "view", F.lit("outro")).otherwise(TOKEN).alias("token"),
        F.to_json(F.struct(
            name.alias("event"), nested.alias("data"),
            F.when((kind == "click") & (F.col("value") > 50), email).alias("email"),
            F.when(kind == "signup", tx).alias("transaction_id"), flat.alias("transaction"),
        )).alias("payload"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.extract_events(payloads(spark, sf_dir)).drop("payload")


def event_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", "event", "email", "transaction_id")


def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.authorized(events(spark, sf_dir), TOKEN).select("seq", "event")


def event_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.event_outcomes(spark, events(spark, sf_dir)).select("seq", "outcome")


def event_outcome_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels with the hot-transaction path taken."""
    return rg.event_outcomes(spark, events(spark, sf_dir), hot_rows=70).select("seq", "outcome")


def registry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.fold_registry(events(spark, sf_dir))


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries of customers who placed an urgent order."""
    keys = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.nullif(F.col("o_custkey").cast("string"), F.lit("7")).alias("transaction_id")
    )
    return rg.lookup(rg.fold_registry(events(spark, sf_dir)), keys).select("transaction_id", "status")


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registry entries: subscriptions run out with the order date's day."""
    kind = F.when(F.col("o_orderstatus") == "P", rg.SUBSCRIPTION).otherwise(rg.PERPETUAL)
    until = F.when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("")
    until = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(until, F.lit("x"))).otherwise(until)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", kind.alias("tipo"), until.alias("validade"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("hw-"), F.col("o_custkey").cast("string")))
        .otherwise("").alias("hardware_id"),
    )


def registry_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rg.expiry(F.col("tipo"), F.col("validade"))
    return registry_rows(spark, sf_dir).select("o_orderkey", e["expira_em"].alias("expira_em"), e["erro"].alias("erro"))


def registry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry_rows(spark, sf_dir)
    registry = rows.select(
        F.col("o_orderkey").cast("string").alias("transaction_id"), F.col("validade").alias("expira_em"), "hardware_id"
    )
    activations = rows.select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.when(F.col("tipo") == rg.SUBSCRIPTION, F.concat(F.lit("HW-"), F.col("o_custkey").cast("string")))
        .otherwise("HW-1").alias("hardware_id"),
    )
    checked = rg.audit_validity(spark, registry, activations, F.to_date(F.lit("1998-06-30")))
    return checked.select("transaction_id", "validity")


def registry_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of three generations: without status, without transaction, complete."""
    folder = fresh(spark, "registry_evolve")
    o = table(spark, sf_dir, "orders")
    base = o.select(
        "o_orderstatus", F.col("o_orderkey").alias("id"), F.lit("a@x.org").alias("email"), F.lit(rg.PERPETUAL).alias("tipo"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("emitida_em"),
    )
    f = base.where("o_orderstatus = 'F'").drop("o_orderstatus")
    p = base.where("o_orderstatus = 'P'").drop("o_orderstatus")
    n = base.where("o_orderstatus = 'O'").drop("o_orderstatus")
    f.write.parquet(f"{folder}/v1")
    p.withColumn("status", F.when(F.col("id") % 2 == 0, rg.REVOKED)).write.parquet(f"{folder}/v2")
    n.withColumn("status", F.lit(rg.REVOKED)).withColumn(
        "transaction_id", F.col("id").cast("string")).write.parquet(f"{folder}/v3")
    return rg.read_registry(spark, folder).select("id", "emitida_em", "tipo", "status", "transaction_id", "hardware_id")


def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries appended in two goes: the first go's ids come first, without gaps."""
    folder = fresh(spark, "registry_append") + "/registro"
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"), F.lit("a@x.org").alias("email"), "o_orderstatus"
    )
    rg.append_rows(spark, o.where("o_orderstatus = 'F'"), folder)
    rg.append_rows(spark, o.where("o_orderstatus <> 'F'"), folder)
    first = o.where("o_orderstatus = 'F'").count()
    ids = rg.read_registry(spark, folder).select("id", "transaction_id", "email", "status")
    # With ids from 1 on and no gaps, the sorted ids are the positions; a repeated or skipped one would pair badly.
    every = spark.range(1, o.count() + 1).select("id", F.lit(True).alias("no_lugar"))
    return ids.join(every, "id", "full").select(
        "transaction_id", "email", "status", (F.col("id") <= first).alias("primeira"), F.coalesce("no_lugar", F.lit(False)).alias("no_lugar"))


def registry_concurrent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers that append at the same time: each writer's ids lie together, and none is missing or given twice."""
    folder = fresh(spark, "registry_concurrent") + "/registro"
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"), F.col("o_orderpriority").alias("email"))
    kinds = [f"o_orderpriority = '{k}'" for k in ("1-URGENT", "2-HIGH", "3-MEDIUM")]
    kinds.append(" AND ".join(f"NOT ({k})" for k in kinds))
    with ThreadPoolExecutor(len(kinds)) as pool:
        list(pool.map(lambda k: rg.append_rows(spark, o.where(k.replace("o_orderpriority", "email")), folder), kinds))
    ids = rg.read_registry(spark, folder).select("id", "email")
    every = spark.range(1, o.count() + 1).select("id", F.lit(True).alias("no_lugar"))
    writer = F.when(F.col("email").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.col("email")).otherwise("outros")
    return ids.join(every, "id", "full").groupBy(writer.alias("escritor")).agg(
        (F.max("id") - F.min("id") + 1 == F.count_distinct("id")).alias("junto"), F.count(F.lit(1)).alias("linhas"),
        F.bool_and(F.coalesce("no_lugar", F.lit(False))).alias("no_lugar"))


def registry_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold as a stream in five deliveries, read from a snapshot and the changes behind it."""
    folder = fresh(spark, "registry_compacted")
    rows = payloads(spark, sf_dir)
    for k in range(5):
        rows.where(F.col("seq") % 5 == k).select("seq", "payload").write.mode("append").parquet(f"{folder}/eventos")
        source = spark.readStream.schema("seq bigint, payload string").parquet(f"{folder}/eventos")
        stream_registry(source, f"{folder}/registro", f"{folder}/controle", share=0.9).awaitTermination()
    return current_registry(spark, f"{folder}/registro")


def stream_registry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold as a stream over the same payloads, restarted between two deliveries."""
    folder = fresh(spark, "stream_registry")
    rows = payloads(spark, sf_dir)
    for delivery in (F.col("token") == TOKEN, F.col("token") != TOKEN):
        rows.where(delivery).select("seq", "payload").write.mode("append").parquet(f"{folder}/eventos")
        source = spark.readStream.schema("seq bigint, payload string").parquet(f"{folder}/eventos")
        stream_registry(source, f"{folder}/registro", f"{folder}/controle").awaitTermination()
    return current_registry(spark, f"{folder}/registro")


QUERIES = {
    "event_extract": event_extract, "event_filter": event_filter, "event_outcome": event_outcome,
    "event_outcome_hot": event_outcome_hot, "registry_fold": registry_fold, "registry_lookup": registry_lookup,
    "registry_append": registry_append, "registry_compacted": registry_compacted,
    "registry_concurrent_append": registry_concurrent_append, "registry_evolve": registry_evolve, "registry_expiry": registry_expiry,
    "registry_validity": registry_validity, "stream_registry_fold": stream_registry_fold,
}

_EVENTS = """
    e AS (SELECT event_id AS seq, event_type AS kind,
            CASE event_type WHEN 'purchase' THEN 'PURCHASE_APPROVED' WHEN 'click' THEN 'PURCHASE_APPROVED'
              WHEN 'error' THEN 'PURCHASE_REFUNDED' WHEN 'signup' THEN 'PURCHASE_CANCELED' ELSE upper(event_type) END AS event,
            CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND value > 50)
              THEN 'u' || user_id || '-' || event_id || '@x.org' END AS email,
            CASE WHEN event_type IN ('purchase', 'error', 'signup') OR (event_type = 'click' AND value > 10)
              THEN CAST(user_id AS VARCHAR) END AS transaction_id FROM events)"""
_FOLD = f"""
    {_EVENTS},
    f AS (SELECT transaction_id,
            min(seq) FILTER (event = 'PURCHASE_APPROVED' AND email IS NOT NULL) AS approved_at,
            max(seq) FILTER (event IN ('PURCHASE_REFUNDED', 'PURCHASE_CANCELED')) AS revoked_at,
            min_by(email, seq) FILTER (event = 'PURCHASE_APPROVED' AND email IS NOT NULL) AS email
          FROM e WHERE transaction_id IS NOT NULL GROUP BY transaction_id),
    r AS (SELECT transaction_id, email, 'perpetua' AS tipo,
            CASE WHEN revoked_at > approved_at THEN 'revogada' ELSE 'ativa' END AS status, approved_at
          FROM f WHERE approved_at IS NOT NULL)"""
_OUTCOME = f"""
    WITH {_EVENTS}, w AS (SELECT *, min(CASE WHEN event = 'PURCHASE_APPROVED' AND email IS NOT NULL THEN seq END) OVER (
        PARTITION BY transaction_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT seq, CASE WHEN transaction_id IS NULL THEN 'missing_transaction_id'
      WHEN event = 'PURCHASE_APPROVED' AND email IS NULL THEN 'missing_email'
      WHEN event = 'PURCHASE_APPROVED' AND before IS NOT NULL THEN 'already_processed'
      WHEN event = 'PURCHASE_APPROVED' THEN 'success'
      WHEN event IN ('PURCHASE_REFUNDED', 'PURCHASE_CANCELED') AND before IS NOT NULL THEN 'revoked'
      WHEN event IN ('PURCHASE_REFUNDED', 'PURCHASE_CANCELED') THEN 'transaction_not_found'
      ELSE 'unhandled_event_' || event END AS outcome FROM w"""
_ROWS = """
    o AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'assinatura' ELSE 'perpetua' END AS tipo,
            CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '1-URGENT'
              THEN strftime(o_orderdate, '%Y-%m-%d') || 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS validade,
            o_orderstatus <> 'F' AS preso FROM orders)"""

ORACLE = {
    "event_extract": f"WITH {_EVENTS} SELECT seq, event, email, transaction_id FROM e",
    "event_filter": f"WITH {_EVENTS} SELECT seq, event FROM e WHERE kind <> 'view'",
    "event_outcome": _OUTCOME,
    "event_outcome_hot": _OUTCOME,
    "registry_fold": f"WITH {_FOLD} SELECT * FROM r",
    "registry_lookup": f"""
        WITH {_FOLD} SELECT transaction_id, status FROM r WHERE transaction_id IN (
            SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey <> 7)""",
    "registry_append": """
        SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, 'a@x.org' AS email, 'ativa' AS status,
               o_orderstatus = 'F' AS primeira, true AS no_lugar FROM orders""",
    "registry_compacted": f"WITH {_FOLD} SELECT * FROM r",
    "registry_concurrent_append": """
        SELECT CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3') THEN o_orderpriority ELSE 'outros' END AS escritor,
               true AS junto, count(*) AS linhas, true AS no_lugar
        FROM orders GROUP BY ALL""",
    "registry_evolve": """
        SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS emitida_em, 'perpetua' AS tipo,
               CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0) THEN 'revogada'
                    ELSE 'ativa' END AS status,
               CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS VARCHAR) END AS transaction_id,
               CAST(NULL AS VARCHAR) AS hardware_id FROM orders""",
    "registry_expiry": f"""
        WITH {_ROWS} SELECT o_orderkey, CASE WHEN length(validade) = 10 THEN validade || 'T23:59:59Z' END AS expira_em,
               CASE WHEN validade = '' AND tipo = 'assinatura' THEN 'assinatura exige data de validade'
                    WHEN length(validade) = 11 THEN 'data de validade inválida' END AS erro FROM o""",
    "registry_validity": f"""
        WITH {_ROWS} SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
               CASE WHEN validade <> '' AND left(validade, 10) < '1998-06-30' THEN 'expired'
                    WHEN preso AND tipo <> 'assinatura' AND o_custkey <> 1 THEN 'other_hardware'
                    ELSE 'valid' END AS validity FROM o""",
    "stream_registry_fold": f"WITH {_FOLD} SELECT * FROM r",
}
