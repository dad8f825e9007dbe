"""Times the ingestion jobs on source files written from the tables of ``$BENCH_SF_DIR``.

Writing the sources is not timed. Every job is run once on the nation-sized warm-up data of the
smallest scale, then timed. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lakeingest import IngestOptions, ingest  # noqa: E402
from lakeingest.catalog import csvs, jsons, registries, workbooks  # noqa: E402
from lakeingest.catalog.samples import blocks, fresh, table, write_files, write_lines  # noqa: E402
from lakeingest.operators import registry as rg  # noqa: E402
from lakeingest.streaming.registry import current_registry, stream_registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("lakeingest-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ingest_job(prepare, **options):
    """A job from a source writer: the sources are written first, the ingestion is timed."""

    def job(spark, sf_dir):
        folder = fresh(spark, "bench")
        files = prepare(spark, sf_dir, folder)
        out = fresh(spark, "bench-out")
        return lambda: ingest(spark, [files], out, IngestOptions(**options)).audit.agg(F.sum("linhas_lidas")).first()[0]

    return job


def quoted_documents(spark, sf_dir, folder):
    rows = table(spark, sf_dir, "documents").select(
        F.concat_ws(",", "doc_id", "lang", csvs.quoted("text")).alias("value")
    )
    return write_lines(rows.repartition(8), f"{folder}/textos", "csv", "doc_id,lang,text", "cp1252")


def lineitem(spark, sf_dir, folder):
    return csvs.lineitem_files(spark, sf_dir, folder, 8)


def documents(spark, sf_dir, folder):
    parts = blocks(table(spark, sf_dir, "orders").withColumn("value", jsons.order_items()), "o_orderkey", 1000, ",\n")
    doc = F.concat(F.lit('{"status":"ok",\n"items":['), F.col("body"), F.lit("]}\n"))
    return write_files(parts.select(F.format_string("d%06d.json", "bloco").alias("name"), doc.alias("content")), f"{folder}/docs")


def small_files(spark, sf_dir, folder):
    """1 000 files of five layouts at sf0.1, from customers and parts."""
    customer = table(spark, sf_dir, "customer")
    text = lambda sep: F.concat_ws(sep, F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))
    turn = F.floor(F.col("c_custkey") / 20) % 4
    value = F.when(turn == 0, text(",")).when(turn == 1, text(";")).when(turn == 2, text("|")).otherwise(
        F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")))
    c = blocks(customer.withColumn("value", value), "c_custkey", 20)
    turn = F.col("bloco") % 4
    sep = F.when(turn == 0, ",").when(turn == 1, ";").otherwise("|")
    head = F.when(turn == 3, "").otherwise(F.concat(F.lit("chave"), sep, F.lit("nome"), sep, F.lit("saldo\n")))
    write_files(c.select(
        F.concat(F.format_string("c%06d", "bloco"), F.when(turn == 3, ".jsonl").otherwise(".csv")).alias("name"),
        F.concat(head, "body").alias("content")), f"{folder}/pequenos")
    part = table(spark, sf_dir, "part").withColumn("value", F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name"))
    p = blocks(part, "p_partkey", 80)
    write_files(p.select(F.format_string("p%06d.csv", "bloco").alias("name"),
                         F.concat(F.lit("peca\tnome\n"), "body").alias("content")), f"{folder}/pequenos")
    return f"{folder}/pequenos"


def fold(spark, sf_dir):
    return lambda: registries.registry_fold(spark, sf_dir).agg(F.count(F.lit(1))).first()[0]


def outcomes(spark, sf_dir):
    events = registries.events(spark, sf_dir)
    return lambda: rg.event_outcomes(spark, events).groupBy("outcome").count().agg(F.sum("count")).first()[0]


def stream(spark, sf_dir):
    folder = fresh(spark, "bench-stream")
    registries.payloads(spark, sf_dir).select("seq", "payload").write.parquet(f"{folder}/in")

    def run():
        source = spark.readStream.schema("seq bigint, payload string").parquet(f"{folder}/in")
        stream_registry(source, f"{folder}/out", f"{folder}/ck").awaitTermination()
        return current_registry(spark, f"{folder}/out").count()

    return run


JOBS = {
    "csv_types": ingest_job(lineitem),
    "csv_convert": ingest_job(csvs.customer_files, normalize=True),
    "csv_cp1252": ingest_job(quoted_documents),
    "ndjson_tolerant": ingest_job(jsons.event_files, flatten=True, continue_on_error=True),
    "json_flatten": ingest_job(jsons.flatten_files, flatten=True),
    "json_document": ingest_job(documents),
    "small_files": ingest_job(small_files),
    "xlsx_convert": ingest_job(workbooks.order_books),
    "registry_fold": fold,
    "event_outcome": outcomes,
    "stream_registry_fold": stream,
}


def main() -> None:
    spark = session()
    wanted = sys.argv[1:] or list(JOBS)
    times, rows = {}, {}
    for name in wanted:
        JOBS[name](spark, WARM_DIR)()
    for name in wanted:
        run = JOBS[name](spark, SF_DIR)
        started = time.perf_counter()
        rows[name] = run()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "ingest_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows": rows, "rows_per_sec": {k: round(rows[k] / t) for k, t in times.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
