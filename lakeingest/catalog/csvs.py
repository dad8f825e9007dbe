"""Queries on delimited text, each ingesting files written from a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.catalog.samples import fresh, table, write_lines
from lakeingest.options import IngestOptions
from lakeingest.plans.ingest import IngestResult, ingest
from lakeingest.session import isolated

CUSTOMER_HEADER = "Código;Nome Cliente;CEP;Saldo"
LINEITEM_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def quoted(c: str):
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def customer_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(
        ";", F.format_string("%08d", "c_custkey"), "c_name", F.format_string("%08d", "c_nationkey"),
        F.col("c_acctbal").cast("string"),
    ).alias("value"))
    return write_lines(rows, f"{folder}/clientes", "csv", CUSTOMER_HEADER)


def lineitem_files(spark: SparkSession, sf_dir: str, folder: str, partitions: int | None = None) -> str:
    df = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    if partitions and df.rdd.getNumPartitions() < partitions:  # at least so many files, and no whole table in few tasks
        df = df.repartition(partitions)
    rows = df.select(F.concat_ws(",", *LINEITEM_COLUMNS).alias("value"))
    return write_lines(rows, f"{folder}/itens", "csv", ",".join(LINEITEM_COLUMNS))


def run(spark, roots, folder, **options) -> IngestResult:
    return ingest(spark, [roots], f"{folder}/out", IngestOptions(hash_sources=False, **options))


def csv_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier columns keep their zeros, headers are normalised, the balance is numeric."""
    folder = fresh(spark, "csv_convert")
    return run(spark, customer_files(spark, sf_dir, folder), folder, normalize=True).table()


def csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, decimals and text are told apart; dates stay text."""
    folder = fresh(spark, "csv_types")
    return run(spark, lineitem_files(spark, sf_dir, folder), folder).table()


def csv_cp1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in code page 1252 with quoted line breaks."""
    folder = fresh(spark, "csv_cp1252")
    rows = table(spark, sf_dir, "documents").select(
        F.concat_ws(",", "doc_id", "lang", quoted("text"), F.lit('"“ção”…€"')).alias("value")
    )
    files = write_lines(rows, f"{folder}/textos", "csv", "doc_id,lang,text,marca", "cp1252")
    return run(spark, files, folder).table()


def csv_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted line breaks in files that are read in many small splits."""
    folder, small = fresh(spark, "csv_split_records"), isolated(spark)
    small.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(
        ",", F.concat("conv_id", F.lit("")), "turn", "role", quoted("text")
    ).alias("value"))
    files = write_lines(rows, f"{folder}/conversas", "csv", "conv_id,turn,role,text")
    return spark.read.parquet(*run(small, files, folder).folders).drop("lake_source")


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra fields of a row are dropped, missing ones are null."""
    folder = fresh(spark, "csv_ragged")
    fields = [F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_brand", "p_size")]
    value = (
        F.when(F.col("p_size") > 40, F.concat_ws(",", *fields, F.lit("a"), F.lit("b")))
        .when(F.col("p_size") < 5, F.concat_ws(",", *fields[:2]))
        .otherwise(F.concat_ws(",", *fields))
    )
    rows = table(spark, sf_dir, "part").select(value.alias("value"))
    files = write_lines(rows, f"{folder}/pecas", "csv", "p_partkey,p_name,p_brand,p_size")
    return run(spark, files, folder).table()


def csv_dup_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and blank header names."""
    folder = fresh(spark, "csv_dup_headers")
    rows = table(spark, sf_dir, "supplier").select(F.concat_ws(
        "|", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"),
        F.col("s_acctbal").cast("string"),
    ).alias("value"))
    files = write_lines(rows, f"{folder}/fornecedores", "csv", "chave|nome||nome")
    return run(spark, files, folder).table()


# One delimiter and encoding per order priority.
PRIORITY_LAYOUTS = {
    "1-URGENT": (",", "utf-8"), "2-HIGH": (";", "cp1252"), "3-MEDIUM": ("\t", "utf-8"),
    "4-NOT SPECIFIED": ("|", "cp1252"), "5-LOW": (";", "utf-8"),
}


def priority_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    orders = table(spark, sf_dir, "orders")
    for priority, (sep, encoding) in PRIORITY_LAYOUTS.items():
        rows = orders.where(F.col("o_orderpriority") == priority).select(F.concat_ws(
            sep, F.col("o_orderkey").cast("string"), F.lit("situação é"), F.col("o_totalprice").cast("string")
        ).alias("value"))
        write_lines(rows, f"{folder}/pedidos/{priority[0]}", "csv", sep.join(("pedido", "obs", "total")), encoding)
    return f"{folder}/pedidos"


def csv_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected encoding and delimiter, with the rows read under them."""
    folder = fresh(spark, "csv_detect")
    audit = run(spark, priority_files(spark, sf_dir, folder), folder, continue_on_error=True).audit
    return audit.groupBy(
        F.regexp_extract("caminho_original", r"/pedidos/(\d)/", 1).alias("prioridade"),
        F.col("csv_encoding").alias("encoding"), F.col("csv_separador").alias("sep"),
    ).agg(F.sum("linhas_lidas").alias("linhas"))


def csv_per_file_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types per file: a field that is numeric in the files of one flag is text in the others'; every task writes files."""
    folder = fresh(spark, "csv_per_file_schema")
    for flag in ("A", "N", "R"):
        rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.concat_ws(
            ",", F.col("l_orderkey").cast("string"),
            (F.col("l_linestatus") if flag == "A" else F.col("l_quantity").cast("string") if flag == "N"
             else F.col("l_linenumber").cast("string")),
        ).alias("value"))
        write_lines(rows, f"{folder}/por_arquivo/{flag}", "csv", "pedido,valor")
    result = run(spark, f"{folder}/por_arquivo", folder, per_file_schema=True)
    return result.audit.groupBy(
        F.regexp_extract("caminho_original", r"/([A-Z])/[^/]*$", 1).alias("arquivo"),
        F.col("tipos_inferidos")["valor"].alias("tipo"),
    ).agg(F.sum("linhas_lidas").alias("linhas"))


QUERIES = {
    "csv_convert": csv_convert, "csv_types": csv_types, "csv_cp1252": csv_cp1252,
    "csv_split_records": csv_split_records, "csv_ragged": csv_ragged,
    "csv_dup_headers": csv_dup_headers, "csv_detect": csv_detect,
    "csv_per_file_schema": csv_per_file_schema,
}

ORACLE = {
    "csv_convert": """
        SELECT printf('%08d', c_custkey) AS codigo, c_name AS nome_cliente,
               printf('%08d', c_nationkey) AS cep, c_acctbal AS saldo FROM customer""",
    "csv_types": """
        SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
               strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem""",
    "csv_cp1252": r"""
        SELECT doc_id, lang, nullif(regexp_replace(text, '[^\x00-\xFF]', '?', 'g'), '') AS text,
               '“ção”…€' AS marca FROM documents""",
    "csv_split_records": "SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations",
    "csv_ragged": """
        SELECT p_partkey, p_name, CASE WHEN p_size >= 5 THEN p_brand END AS p_brand,
               CAST(CASE WHEN p_size >= 5 THEN p_size END AS BIGINT) AS p_size FROM part""",
    "csv_dup_headers": """
        SELECT s_suppkey AS chave, s_name AS nome, CAST(s_nationkey AS BIGINT) AS coluna_sem_nome,
               s_acctbal AS nome_duplicada_3 FROM supplier""",
    "csv_detect": r"""
        SELECT left(o_orderpriority, 1) AS prioridade,
               CASE WHEN left(o_orderpriority, 1) IN ('2', '4') THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding,
               CASE left(o_orderpriority, 1) WHEN '1' THEN ',' WHEN '3' THEN chr(9) WHEN '4' THEN '|' ELSE ';' END AS sep,
               count(*) AS linhas FROM orders GROUP BY ALL""",
    "csv_per_file_schema": """
        SELECT l_returnflag AS arquivo,
               CASE l_returnflag WHEN 'A' THEN 'String' WHEN 'N' THEN 'Float64' ELSE 'Int64' END AS tipo,
               count(*) AS linhas FROM lineitem GROUP BY ALL""",
}
