"""Queries on inputs that are wider, larger or more mixed than usual, each from whole tables."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.catalog.jsons import order_items
from lakeingest.catalog.samples import blocks, fresh, table, write_files, write_lines
from lakeingest.catalog.workbooks import workbook_bytes
from lakeingest.options import IngestOptions
from lakeingest.plans.audit import write_reports
from lakeingest.plans.ingest import ingest

WIDE = 12_000  # letters in a column name: eleven of them exceed the sample of a file's head
BOOK_ROWS = 2_000
BLOCK = 250


def _name(i: int) -> str:
    return f"c{i:02d}_" + "x" * WIDE


def csv_wide_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header record longer than the sampled head: all columns are there, with their types."""
    folder = fresh(spark, "csv_wide_header")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", *[(F.col("p_partkey") * i).alias(f"k{i}") for i in range(10)])
    rows = part.select(F.concat_ws(",", *part.columns).alias("value"))
    files = write_lines(rows, f"{folder}/largos", "csv", ",".join(_name(i) for i in range(12)))
    df = ingest(spark, [files], f"{folder}/out", IngestOptions(hash_sources=False)).table()
    return df.select(*[F.col(c).alias(c[:3]) for c in df.columns])


def xlsx_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows wider than their header row: what lies behind it is kept under names of its own."""
    folder = fresh(spark, "xlsx_ragged")
    orders = table(spark, sf_dir, "orders").withColumn("bloco", F.floor(F.col("o_orderkey") / BOOK_ROWS))

    def book(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o_orderkey")
        body = [["pedido"]] + [[int(k), s, float(p)] if s == "F" else [int(k)] for k, s, p in zip(rows.o_orderkey, rows.o_orderstatus, rows.o_totalprice)]
        return pd.DataFrame({"name": [f"b{key[0]:06d}.xlsx"], "content": [workbook_bytes({"Dados": [*body, [-1, "F", 0.5]]})]})

    files = write_files(orders.groupBy("bloco").applyInPandas(book, "name string, content binary"), f"{folder}/livros")
    df = ingest(spark, [files], f"{folder}/out", IngestOptions(normalize=True, hash_sources=False)).table()
    chave, marca, valor = df.columns
    return df.where("pedido >= 0").select(F.col(chave).alias("pedido"), F.col(marca).alias("marca"), F.col(valor).alias("valor"))


def json_large_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in documents that many tasks cut into records, and in long-lined files that are no single value."""
    folder = fresh(spark, "json_large_document")
    parts = blocks(table(spark, sf_dir, "orders").withColumn("value", order_items()), "o_orderkey", 10_000, ",\n")
    doc = F.concat(F.lit('{"nada":[],"misto":[1,{"a":2}],"x":NaN,"items":[\n'), F.col("body"), F.lit('],"fim":[{"fora":1}]}'))
    lines = F.concat(F.lit("["), F.replace(F.col("body"), F.lit(",\n"), F.lit(",")), F.lit("]\n[]\n"))
    content = F.when(F.col("bloco") % 3 == 1, lines).otherwise(doc)
    files = write_files(parts.select(F.format_string("d%06d.json", "bloco").alias("name"), content.alias("content")), f"{folder}/docs")
    return ingest(spark, [files], f"{folder}/out", IngestOptions(hash_sources=False, document_bytes=1000)).table().select("id", "cliente", "total")


def report_invalid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invalid line, read back from the JSON reports of the sources."""
    folder = fresh(spark, "report_invalid_lines")
    events = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "user_id"))
    value = F.when(F.col("event_type").isin("error", "click"), F.concat(F.lit("{"), F.col("event_id").cast("string"))).otherwise(good)
    parts = blocks(events.withColumn("value", value), "event_id", 1000)
    files = write_files(parts.select(F.format_string("e%06d.jsonl", "bloco").alias("name"), F.col("body").alias("content")), f"{folder}/eventos")
    result = ingest(spark, [files], f"{folder}/out", IngestOptions(continue_on_error=True, hash_sources=False))
    reports = write_reports(result.audit, f"{folder}/relatorios", result.quarantine)
    reports.write.mode("overwrite").parquet(f"{folder}/caminhos")
    texts = spark.read.text(f"{folder}/relatorios/*.json", wholetext=True)
    schema = "nome_original string, ndjson_linhas_invalidas array<struct<line_number:bigint,content:string,error:string>>"
    doc = texts.select(F.from_json("value", schema).alias("r"))
    return doc.select("r.nome_original", F.explode("r.ndjson_linhas_invalidas").alias("i")).select(
        "nome_original", F.col("i.line_number").alias("linha"), F.col("i.content").alias("conteudo"))


def fault_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken books and CSV files among good ones: each fails alone, and a column may be named like the partition."""
    folder = fresh(spark, "fault_isolation")
    nations = table(spark, sf_dir, "customer").withColumn("bloco", F.floor(F.col("c_custkey") / BLOCK))

    def files(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        pairs = list(zip(rows.c_custkey.astype(int), rows.c_name))
        book = workbook_bytes({"S": [["lake_source", "nome"], *map(list, pairs)]})
        lines = "".join(f"{k},{n}\n" for k, n in pairs)
        text = f"k,nome\n{lines}".encode() if key[0] % 2 else f'k,nome\n{lines}"aberto\n'.encode()
        book = book if key[0] % 3 else book[:100]
        return pd.DataFrame({"name": [f"p{key[0]:06d}.xlsx", f"p{key[0]:06d}.csv"], "content": [book, text]})

    at = write_files(nations.groupBy("bloco").applyInPandas(files, "name string, content binary"), f"{folder}/entrada")
    audit = ingest(spark, [at], f"{folder}/out", IngestOptions(continue_on_error=True, hash_sources=False)).audit
    return audit.select("nome_original", "status", "linhas_lidas")


def mixed_layout_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts that disagree about a column's type are read as one table."""
    folder = fresh(spark, "mixed_layout_types")
    customer = table(spark, sf_dir, "customer")
    number = F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), F.col("c_custkey").cast("string"))
    text = F.concat_ws(",", "c_name", F.col("c_custkey").cast("string"), F.col("c_custkey").cast("string"))
    write_lines(customer.where("c_custkey % 2 = 0").select(number.alias("value")), f"{folder}/in/a", "csv", "v,saldo,k")
    write_lines(customer.where("c_custkey % 2 = 1").select(text.alias("value")), f"{folder}/in/b", "csv", "v,k,saldo")
    return ingest(spark, [f"{folder}/in"], f"{folder}/out", IngestOptions(hash_sources=False)).table().select("k", "v", "saldo")


def json_scalar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists that are no objects keep their own text: decimals, non-finite numbers, and those words in strings."""
    folder = fresh(spark, "json_scalar_items")
    lines = table(spark, sf_dir, "customer")
    item = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("NaN")).otherwise(F.format_string("%d.0", F.col("c_custkey")))
    word = F.concat(F.lit('"'), F.col("c_name"), F.lit(" NaN, -Infinity\""))
    numbers = blocks(lines.withColumn("value", item), "c_custkey", BLOCK, ", ")
    words = blocks(lines.withColumn("value", word), "c_custkey", BLOCK, ", ")
    listed = lambda body: F.concat(F.lit("["), body, F.lit("]"))
    for name, parts in (("numeros", numbers), ("palavras", words)):
        write_files(parts.select(F.format_string("d%06d.json", "bloco").alias("name"), listed(F.col("body")).alias("content")), f"{folder}/{name}")
    run = lambda name: ingest(spark, [f"{folder}/{name}"], f"{folder}/out-{name}", IngestOptions(hash_sources=False)).table()
    kind = F.when(F.isnan("valor"), "NaN").otherwise(F.col("valor").cast("bigint").cast("string"))
    return run("numeros").select(F.lit("numero").alias("forma"), kind.alias("valor")).unionByName(
        run("palavras").select(F.lit("palavra").alias("forma"), "valor"))


QUERIES = {
    "csv_wide_header": csv_wide_header, "xlsx_ragged": xlsx_ragged, "json_large_document": json_large_document,
    "report_invalid_lines": report_invalid_lines, "fault_isolation": fault_isolation,
    "mixed_layout_types": mixed_layout_types, "json_scalar_items": json_scalar_items,
}

_KEYS = ", ".join(f"p_partkey * {i} AS c{i + 2:02d}" for i in range(10))
ORACLE = {
    "csv_wide_header": f"SELECT p_partkey AS c00, p_name AS c01, {_KEYS} FROM part",
    "xlsx_ragged": """
        SELECT o_orderkey AS pedido, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS marca,
               CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS valor FROM orders""",
    "json_large_document": "SELECT o_orderkey AS id, o_custkey AS cliente, o_totalprice AS total FROM orders",
    "report_invalid_lines": """
        WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS linha FROM events)
        SELECT 'e' || printf('%06d', event_id // 1000) || '.jsonl' AS nome_original, linha, '{' || event_id AS conteudo
        FROM l WHERE event_type IN ('error', 'click')""",
    "fault_isolation": f"""
        WITH b AS (SELECT c_custkey // {BLOCK} AS bloco, count(*) AS n FROM customer GROUP BY ALL)
        SELECT 'p' || printf('%06d', bloco) || '.xlsx' AS nome_original,
               CASE WHEN bloco % 3 = 0 THEN 'erro' ELSE 'sucesso' END AS status,
               CASE WHEN bloco % 3 = 0 THEN 0 ELSE n END AS linhas_lidas FROM b
        UNION ALL SELECT 'p' || printf('%06d', bloco) || '.csv', CASE WHEN bloco % 2 = 0 THEN 'erro' ELSE 'sucesso' END,
               CASE WHEN bloco % 2 = 0 THEN 0 ELSE n END FROM b""",
    "mixed_layout_types": """
        SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS v,
               CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE CAST(c_custkey AS DOUBLE) END AS saldo FROM customer""",
    "json_scalar_items": """
        SELECT 'numero' AS forma, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NaN' ELSE CAST(c_custkey AS VARCHAR) END AS valor FROM customer
        UNION ALL SELECT 'palavra', c_name || ' NaN, -Infinity' FROM customer""",
}
