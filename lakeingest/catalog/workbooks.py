"""Queries on Excel workbooks and on the drop-folder stream."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.catalog.csvs import CUSTOMER_HEADER
from lakeingest.catalog.samples import blocks, fresh, table, write_files
from lakeingest.options import IngestOptions
from lakeingest.plans.ingest import ingest
from lakeingest.sources.listing import list_sources
from lakeingest.sources.workbooks import list_sheets
from lakeingest.streaming.dropfolder import stream_folder

BOOK_ROWS = 500


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook: text inline, numbers and booleans as cell values, dates with a style."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006/relationships"

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (pd.Timestamp,)):
            return f'<c s="1"><v>{(v - pd.Timestamp("1899-12-30")) / pd.Timedelta(days=1)!r}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f"<c t=\"inlineStr\"><is><t>{escape(v)}</t></is></c>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)
        )
        links = "".join(
            f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def order_books(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """A workbook per fixed-size block of orders: orders, an empty sheet, and their keys."""
    orders = table(spark, sf_dir, "orders").withColumn("bloco", F.floor(F.col("o_orderkey") / BOOK_ROWS))

    def book(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o_orderkey")
        sheets = {
            "Pedidos & Cia": [["CEP", "pedido", "Total", "Dia", "Urgente", "Misto"]] + [
                [float(k), int(k), float(p), d, pr == "1-URGENT", (int(k) if s == "F" else s)]
                for k, p, d, pr, s in zip(
                    rows.o_orderkey, rows.o_totalprice, rows.o_orderdate, rows.o_orderpriority, rows.o_orderstatus)
            ],
            "Vazia": [],
            "Chaves": [["chave", "cliente"]] + [[f"k{k}", int(c)] for k, c in zip(rows.o_orderkey, rows.o_custkey)],
        }
        return pd.DataFrame({"name": [f"livro_{key[0]:06d}.xlsx"], "content": [workbook_bytes(sheets)]})

    return write_files(orders.groupBy("bloco").applyInPandas(book, "name string, content binary"), f"{folder}/livros")


def xlsx_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "xlsx_sheets")
    files = order_books(spark, sf_dir, folder)
    return list_sheets(list_sources(spark, [files])).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("livro"), "sheet_index", "sheet"
    )


def xlsx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sheets only; identifiers are text without decimals, dates and booleans keep their type."""
    folder = fresh(spark, "xlsx_convert")
    files = order_books(spark, sf_dir, folder)
    df = ingest(spark, [files], f"{folder}/out", IngestOptions(normalize=True, hash_sources=False)).table()
    return df.withColumn("dia", F.col("dia").cast("string"))


def xlsx_all_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets with data, each its own dataset."""
    folder = fresh(spark, "xlsx_all_sheets")
    files = order_books(spark, sf_dir, folder)
    result = ingest(spark, [files], f"{folder}/out", IngestOptions(all_sheets=True, hash_sources=False))
    return result.table(keep_source=True).groupBy("lake_source").agg(
        F.count(F.lit(1)).alias("linhas"), F.count("chave").alias("chaves"), F.count("pedido").alias("pedidos")
    )


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries into a folder, each picked up once by a run of the stream."""
    folder = fresh(spark, "stream_ingest")
    rows = table(spark, sf_dir, "customer").withColumn("value", F.concat_ws(
        ";", F.format_string("%08d", "c_custkey"), "c_name", F.format_string("%08d", "c_nationkey"),
        F.col("c_acctbal").cast("string"),
    ))
    files = blocks(rows, "c_custkey", BOOK_ROWS).select(
        F.format_string("clientes_%06d.csv", "bloco").alias("name"),
        F.concat(F.lit(CUSTOMER_HEADER + "\n"), "body").alias("content"), "bloco",
    )
    options = IngestOptions(normalize=True, continue_on_error=True, hash_sources=False)
    # The first block, then all others, then nothing new.
    for delivery in (F.col("bloco") == 0, F.col("bloco") > 0, None):
        if delivery is not None:
            write_files(files.where(delivery), f"{folder}/entrada")
        stream_folder(spark, f"{folder}/entrada", f"{folder}/out", f"{folder}/controle", options).awaitTermination()
    return spark.read.option("basePath", f"{folder}/out/dados").parquet(f"{folder}/out/dados").drop(
        "lote", "layout", "lake_source"
    )


QUERIES = {
    "xlsx_sheets": xlsx_sheets, "xlsx_convert": xlsx_convert, "xlsx_all_sheets": xlsx_all_sheets,
    "stream_ingest": stream_ingest,
}

_BOOK = f"'livro_' || printf('%06d', o_orderkey // {BOOK_ROWS})"
ORACLE = {
    "xlsx_sheets": f"""
        SELECT DISTINCT {_BOOK} || '.xlsx' AS livro, i AS sheet_index, s AS sheet
        FROM orders, (VALUES (0, 'Pedidos & Cia'), (1, 'Vazia'), (2, 'Chaves')) AS v(i, s)""",
    "xlsx_convert": """
        SELECT CAST(o_orderkey AS VARCHAR) AS cep, o_orderkey AS pedido, o_totalprice AS total,
               strftime(o_orderdate, '%Y-%m-%d') AS dia, o_orderpriority = '1-URGENT' AS urgente,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS misto FROM orders""",
    "xlsx_all_sheets": f"""
        SELECT {_BOOK} || CASE i WHEN 0 THEN '__pedidos_cia' ELSE '__chaves' END || '.parquet' AS lake_source,
               count(*) AS linhas, count(*) FILTER (i = 1) AS chaves, count(*) FILTER (i = 0) AS pedidos
        FROM orders, (VALUES (0), (1)) AS v(i) GROUP BY ALL""",
    "stream_ingest": """
        SELECT printf('%08d', c_custkey) AS codigo, c_name AS nome_cliente,
               printf('%08d', c_nationkey) AS cep, c_acctbal AS saldo FROM customer""",
}
