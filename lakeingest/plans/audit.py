"""Audit rows, their summary, and the reports made of them."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeingest.functions.files import base_name
from lakeingest.sources.remote import resolve, write_bytes

SHOWN_INVALID = 10

AUDIT_FIELDS = (
    "nome_original", "caminho_original", "tamanho_bytes", "hash_sha256", "formato_detectado",
    "data_hora_conversao", "status", "erros", "caminho_parquet_gerado", "compressao_usada",
    "tempo_processamento_segundos", "csv_encoding", "csv_separador", "xlsx_abas_processadas",
    "ndjson_linhas_invalidas", "ndjson_total_invalidas", "linhas_lidas", "colunas_lidas",
    "colunas_originais", "colunas_finais", "tipos_inferidos", "mapa_normalizacao",
)


def status_of(erros: Column, invalid: Column) -> Column:
    return (
        F.when(F.size(erros) > 0, "erro").when(invalid > 0, "sucesso_com_alertas").otherwise("sucesso")
    )


def summarize(audit: DataFrame) -> DataFrame:
    """Batch counters; rows count for successes only."""
    ok = F.col("status").startswith("sucesso")
    return audit.agg(
        F.count(F.lit(1)).alias("arquivos_processados"),
        F.count_if(ok).alias("sucessos"),
        F.count_if(~ok).alias("erros"),
        F.coalesce(F.sum(F.when(ok, F.col("linhas_lidas"))), F.lit(0)).alias("total_linhas"),
    )


def first_invalid(quarantine: DataFrame, key: str) -> DataFrame:
    """Per file: number of invalid lines and the first ten as structs.

    Lines are folded into at most ten per partial aggregate, so a file made of bad lines never
    gathers in one place. The whole list is the quarantine table itself.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("line_number")
    shown = (
        quarantine.withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= SHOWN_INVALID)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("line_number", "content", "error"))).alias("shown"))
    )
    return quarantine.groupBy(key).agg(F.count(F.lit(1)).alias("n_invalid")).join(shown, key)


def report_text(audit: DataFrame) -> Column:
    """The text report of an audit row, as one expression."""
    rule, thin = "=" * 70, "-" * 70
    lit = F.lit
    line = lambda label, value: F.concat(lit(label.ljust(29)), F.coalesce(value.cast("string"), lit("")))
    block = lambda *parts: F.array(*[p if isinstance(p, Column) else lit(p) for p in parts])
    none = F.array().cast("array<string>")
    c = F.col
    status = (
        F.when(c("status") == "sucesso", "✅ SUCESSO")
        .when(c("status") == "sucesso_com_alertas", "⚠️ SUCESSO COM ALERTAS")
        .otherwise("❌ ERRO")
    )
    csv = F.when(
        c("formato_detectado") == "csv",
        block("CONFIGURAÇÃO CSV DETECTADA:", line("  Encoding:", c("csv_encoding")),
              line("  Separador:", c("csv_separador")), thin),
    )
    xlsx = F.when(
        c("formato_detectado") == "xlsx",
        block("CONFIGURAÇÃO EXCEL PROCESSADA:",
              line("  Abas Convertidas:", F.array_join("xlsx_abas_processadas", ", ")), thin),
    )
    mapped = F.transform(
        F.arrays_zip(c("colunas_originais").alias("o"), c("colunas_finais").alias("f")),
        lambda p: F.concat(
            lit("    - '"), p.o, lit("'"),
            F.when(p.o != p.f, F.concat(lit(" -> '"), p.f, lit("'"))).otherwise(""),
        ),
    )
    types = F.transform(c("colunas_finais"), lambda n: F.concat(
        lit("    - "), n, lit(": "), F.coalesce(F.element_at(c("tipos_inferidos"), n), lit(""))
    ))
    has_columns = F.size("colunas_finais") > 0
    invalid = F.when(
        c("ndjson_total_invalidas") > 0,
        F.concat(
            F.array(F.concat(lit("LINHAS INVÁLIDAS PULADAS (NDJSON/JSONL) - Total: "),
                             c("ndjson_total_invalidas").cast("string"), lit(":"))),
            F.flatten(F.transform(F.slice("ndjson_linhas_invalidas", 1, SHOWN_INVALID), lambda i: F.array(
                F.concat(lit("  - Linha "), i.line_number.cast("string"), lit(": "), i.error),
                F.concat(lit("    Conteúdo: "), i.content),
            ))),
            F.when(
                c("ndjson_total_invalidas") > SHOWN_INVALID,
                block("  - ... e mais linhas inválidas (veja o relatório JSON para detalhes)"),
            ).otherwise(none),
            block(thin),
        ),
    )
    errors = F.when(
        F.size("erros") > 0,
        F.concat(block("ERROS OCORRIDOS DURANTE O PROCESSO:"),
                 F.transform("erros", lambda e: F.concat(lit("  - "), e)), block(thin)),
    )
    return F.array_join(F.concat(
        block(rule, "RELATÓRIO TÉCNICO DE CONVERSÃO".center(70), rule,
              line("Data/Hora da Conversão:", c("data_hora_conversao")),
              line("Status Final:", status),
              line("Tempo de Processamento:",
                   F.concat(c("tempo_processamento_segundos").cast("string"), lit(" segundos"))),
              thin, "ARQUIVO ORIGEM:",
              line("  Nome:", c("nome_original")),
              line("  Caminho Completo:", c("caminho_original")),
              line("  Formato Detectado:", F.upper("formato_detectado")),
              line("  Tamanho:", F.concat(c("tamanho_bytes").cast("string"), lit(" bytes"))),
              line("  SHA-256 Hash:", c("hash_sha256")), thin),
        F.coalesce(csv, none), F.coalesce(xlsx, none),
        block("DADOS GERADOS E ESTRUTURA:",
              line("  Total de Linhas Lidas:", c("linhas_lidas")),
              line("  Total de Colunas Lidas:", c("colunas_lidas"))),
        F.when(has_columns, F.concat(block("  Mapeamento de Colunas:"), mapped,
                                     block("  Tipos de Campos Inferidos no Parquet:"), types)).otherwise(none),
        block(thin, "ARQUIVOS DESTINO GERADOS:"),
        F.transform("caminho_parquet_gerado", lambda p: F.concat(lit("  - "), p)),
        block(line("  Compressão Usada:", F.upper("compressao_usada")), thin),
        F.coalesce(errors, none), F.coalesce(invalid, none), block(rule),
    ), "\n")


def write_reports(audit: DataFrame, folder: str, quarantine: DataFrame | None = None) -> DataFrame:
    """Write ``<base>_relatorio.json`` and ``.txt`` for every audit row; returns the paths.

    Sources that share a base name get the same suffix as their dataset. With the quarantine table the
    JSON report lists every invalid line: a source's lines follow its audit row in sorted order and are
    streamed into the file, so that no list of them is ever held.
    """
    parts = audit.select(
        F.col("caminho_original").alias("path"), F.lit(0).cast("bigint").alias("line_number"),
        F.coalesce(
            F.regexp_extract(F.get("caminho_parquet_gerado", F.lit(0)), r"lake_source=(.*)\.parquet$", 1),
            base_name(F.col("nome_original")),
        ).alias("dataset"),
        base_name(F.col("nome_original")).alias("base"),
        F.to_json(F.struct(*AUDIT_FIELDS), {"ignoreNullFields": "false"}).alias("doc"),
        report_text(audit).alias("texto"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("error"),
    )
    if quarantine is not None:
        lines = quarantine.select("path", "line_number", "content", "error")
        parts = parts.unionByName(lines, allowMissingColumns=True).repartition("path").sortWithinPartitions("path", "line_number")
    listed = quarantine is not None

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, tail, lines = None, "", 0
        pretty = lambda v: json.dumps(v, indent=2, ensure_ascii=False)

        def close() -> None:
            if out is not None:
                out.write((("\n  ]" if lines else "]") + tail).encode())
                out.close()

        for batch in batches:
            paths = []
            for row in batch.itertuples():
                if row.doc is None:
                    if out is not None:  # else a line of a source that the audit leaves out
                        item = pretty({"line_number": row.line_number, "content": row.content, "error": row.error})
                        out.write(((",\n" if lines else "\n") + textwrap.indent(item, "    ")).encode())
                        lines += 1
                    continue
                close()
                out, lines = None, 0
                name, doc = row.dataset or row.base, json.loads(row.doc)
                paths += [f"{folder}/{name}_relatorio.{ext}" for ext in ("json", "txt")]
                write_bytes(paths[-1], row.texto.encode())
                if listed:
                    doc["ndjson_linhas_invalidas"] = []
                    head, tail = pretty(doc).split('"ndjson_linhas_invalidas": []')
                    fs, at = resolve(paths[-2])
                    out = fs.open_output_stream(at)
                    out.write((head + '"ndjson_linhas_invalidas": [').encode())
                else:
                    write_bytes(paths[-2], pretty(doc).encode())
            yield pd.DataFrame({"path": paths})
        close()

    return parts.mapInPandas(write, "path string")
