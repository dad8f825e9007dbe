"""Queries on the outcome of mixed batches: audit rows, status, summary, reports, fault policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.catalog.csvs import lineitem_files
from lakeingest.catalog.samples import blocks, fresh, table, write_files
from lakeingest.options import IngestOptions
from lakeingest.plans.audit import report_text, summarize
from lakeingest.plans.ingest import ingest

BLOCK = 250
WAVE_BLOCK, WAVE_FILES = 50, 8


def mixed_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Blocks of customers as CSV, good JSONL, JSONL with bad lines, and broken JSON, in turn.

    A line is bad where the customer is a HOUSEHOLD.
    """
    customer = table(spark, sf_dir, "customer")
    record = F.to_json(F.struct(
        F.col("c_custkey").alias("Código"), F.col("c_name").alias("Nome"), F.col("c_acctbal").alias("saldo")
    ))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))
    bad = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(record, F.lit("}"))).otherwise(record)
    turn = F.floor(F.col("c_custkey") / BLOCK) % 4
    value = F.when(turn == 0, line).when(turn == 2, bad).otherwise(record)
    parts = blocks(customer.withColumn("value", value), "c_custkey", BLOCK)
    turn = F.col("bloco") % 4
    name = F.concat(
        F.format_string("bloco_%06d", "bloco"),
        F.when(turn == 0, ".csv").when(turn == 3, ".json").otherwise(".jsonl"),
    )
    body = F.when(turn == 0, F.concat(F.lit("Código,Nome,saldo\n"), "body")).when(
        turn == 3, F.concat(F.lit("["), "body")).otherwise(F.col("body"))
    return write_files(parts.select(name.alias("name"), body.alias("content")), f"{folder}/misto")


def mixed_run(spark: SparkSession, sf_dir: str, label: str, **options):
    folder = fresh(spark, label)
    files = mixed_files(spark, sf_dir, folder)
    return ingest(spark, [files], f"{folder}/out", IngestOptions(normalize=True, **options))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = mixed_run(spark, sf_dir, "audit_rows", continue_on_error=True, hash_sources=False).audit
    return audit.select(
        "nome_original", "formato_detectado", F.size("erros").alias("n_erros"), "csv_separador",
        F.size("caminho_parquet_gerado").alias("saidas"), "colunas_lidas",
        F.array_join("colunas_originais", ",").alias("originais"),
        F.array_join("colunas_finais", ",").alias("finais"), "compressao_usada",
    )


def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = mixed_run(spark, sf_dir, "audit_status", continue_on_error=True, hash_sources=False).audit
    return audit.select("nome_original", "status", "linhas_lidas", "ndjson_total_invalidas")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(mixed_run(spark, sf_dir, "audit_summary", continue_on_error=True, hash_sources=False).audit)


def audit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the text reports but those that tell when and where the run took place."""
    audit = mixed_run(spark, sf_dir, "audit_text", continue_on_error=True).audit
    text = audit.select("nome_original", report_text(audit).alias("texto"))
    return text.select("nome_original", F.explode(F.split("texto", "\n")).alias("linha")).where(
        ~F.col("linha").rlike("^(Data/Hora|Tempo|  Caminho|  - file:|  - /)")
    )


def fault_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run stops behind the first failing file; earlier outputs stay, later ones do not exist."""
    result = mixed_run(spark, sf_dir, "fault_policy", hash_sources=False)
    written = result.table(keep_source=True).groupBy("lake_source").agg(F.count(F.lit(1)).alias("escritas"))
    return result.audit.select(
        "nome_original", "status", F.regexp_extract(F.get("erros", F.lit(0)), r"^Linha (\d+)", 1).alias("linha"),
        F.regexp_replace("nome_original", r"\.[^.]*$", ".parquet").alias("lake_source"),
    ).join(written, "lake_source", "full").select("nome_original", "status", "linha", "escritas")


def stop_in_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop in waves of files: blocks of customers as JSON lines, of which the last third has broken ones."""
    folder = fresh(spark, "stop_in_waves")
    customer = table(spark, sf_dir, "customer")
    record = F.to_json(F.struct("c_custkey", "c_name"))
    last = customer.agg((F.max("c_custkey") * 2).alias("twice"))
    value = F.when(F.col("c_custkey") * 3 > F.col("twice"), F.concat(record, F.lit("}"))).otherwise(record)
    parts = blocks(customer.join(F.broadcast(last)).withColumn("value", value), "c_custkey", WAVE_BLOCK)  # one row
    name = F.concat(F.format_string("onda_%08d", "bloco"), F.lit(".jsonl"))
    files = write_files(parts.select(name.alias("name"), F.col("body").alias("content")), f"{folder}/ondas")
    result = ingest(spark, [files], f"{folder}/out", IngestOptions(hash_sources=False, wave_files=WAVE_FILES))
    written = result.table(keep_source=True).groupBy("lake_source").agg(
        F.count(F.lit(1)).alias("escritas"), F.sum("c_custkey").alias("soma"))
    return result.audit.select(
        "nome_original", "status", F.regexp_extract(F.get("erros", F.lit(0)), r"^Linha (\d+)", 1).alias("linha"),
        F.regexp_replace("nome_original", r"\.[^.]*$", ".parquet").alias("lake_source"),
    ).join(written, "lake_source", "full").select("nome_original", "status", "linha", "escritas", "soma")


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "inferred_types")
    files = lineitem_files(spark, sf_dir, folder, 4)
    audit = ingest(spark, [files], f"{folder}/out", IngestOptions(hash_sources=False)).audit
    return audit.select(F.explode("tipos_inferidos").alias("coluna", "tipo"), "linhas_lidas").groupBy(
        "coluna", "tipo").agg(F.sum("linhas_lidas").alias("linhas"))


QUERIES = {
    "audit_rows": audit_rows, "audit_status": audit_status, "audit_summary": audit_summary,
    "audit_text": audit_text, "fault_policy": fault_policy, "inferred_types": inferred_types,
    "stop_in_waves": stop_in_waves,
}

_BASE = f"""
    c AS (SELECT *, c_custkey // {BLOCK} AS bloco, (c_custkey // {BLOCK}) % 4 AS vez,
                 row_number() OVER (PARTITION BY c_custkey // {BLOCK} ORDER BY c_custkey) AS pos,
                 c_mktsegment = 'HOUSEHOLD' AS ruim FROM customer),
    b AS (SELECT bloco, vez, count(*) AS n, count(*) FILTER (ruim) AS ruins, min(pos) FILTER (ruim) AS primeira,
                 'bloco_' || printf('%06d', bloco) AS base,
                 CASE vez WHEN 0 THEN 'csv' WHEN 3 THEN 'json' ELSE 'jsonl' END AS formato
          FROM c GROUP BY bloco, vez),
    s AS (SELECT *, base || '.' || formato AS nome_original,
                 CASE WHEN vez = 3 OR (vez = 2 AND ruins = n) THEN 'erro'
                      WHEN vez = 2 AND ruins > 0 THEN 'sucesso_com_alertas' ELSE 'sucesso' END AS status,
                 CASE WHEN vez = 3 THEN 0 WHEN vez = 2 THEN n - ruins ELSE n END AS linhas_lidas,
                 CASE WHEN vez = 2 THEN ruins ELSE 0 END AS ndjson_total_invalidas FROM b)"""

ORACLE = {
    "audit_rows": f"""
        WITH {_BASE}
        SELECT nome_original, formato AS formato_detectado, CASE WHEN status = 'erro' THEN 1 ELSE 0 END AS n_erros,
               CASE WHEN vez = 0 THEN ',' END AS csv_separador, CASE WHEN status = 'erro' THEN 0 ELSE 1 END AS saidas,
               CASE WHEN vez = 3 THEN 0 ELSE 3 END AS colunas_lidas,
               CASE WHEN vez = 3 THEN '' ELSE 'Código,Nome,saldo' END AS originais,
               CASE WHEN vez = 3 THEN '' ELSE 'codigo,nome,saldo' END AS finais, 'snappy' AS compressao_usada FROM s""",
    "audit_status": f"WITH {_BASE} SELECT nome_original, status, linhas_lidas, ndjson_total_invalidas FROM s",
    "audit_summary": f"""
        WITH {_BASE}
        SELECT count(*) AS arquivos_processados, count(*) FILTER (status <> 'erro') AS sucessos,
               count(*) FILTER (status = 'erro') AS erros,
               CAST(coalesce(sum(linhas_lidas) FILTER (status <> 'erro'), 0) AS BIGINT) AS total_linhas FROM s""",
    "audit_text": f"""
        WITH {_BASE}, cols AS (SELECT * FROM (VALUES ('Código', 'codigo', 'String'), ('Nome', 'nome', 'String'), ('saldo', 'saldo', 'Float64')) v(o, f, t)),
        t AS (SELECT *, '{{"Código":' || c_custkey || ',"Nome":"' || c_name || '","saldo":' || c_acctbal || '}}' AS doc FROM c),
        l AS (SELECT *, CASE WHEN vez = 0 THEN c_custkey || ',' || c_name || ',' || c_acctbal
                 WHEN vez = 2 AND ruim THEN doc || '}}' ELSE doc END AS linha_fonte FROM t),
        k AS (SELECT bloco, CASE vez WHEN 0 THEN 'Código,Nome,saldo' || chr(10) WHEN 3 THEN '[' ELSE '' END
                 || string_agg(linha_fonte, chr(10) ORDER BY c_custkey) AS conteudo FROM l GROUP BY bloco, vez),
        a AS (SELECT s.*, octet_length(encode(conteudo)) AS bytes, sha256(conteudo) AS hash,
                 CASE WHEN vez = 3 THEN 'arquivo JSON malformado' WHEN status = 'erro'
                   THEN 'Nenhum registro válido encontrado no arquivo' END AS erro FROM s JOIN k USING (bloco)),
        r AS (SELECT nome_original, l.pos, linha_fonte FROM s JOIN l USING (bloco)
              WHERE s.vez = 2 AND l.ruim QUALIFY row_number() OVER (PARTITION BY bloco ORDER BY l.pos) <= 10),
        fixas AS (SELECT nome_original, unnest([repeat('=', 70), repeat('=', 70), repeat('=', 70), '{"RELATÓRIO TÉCNICO DE CONVERSÃO".center(70)}',
                 'ARQUIVO ORIGEM:', 'DADOS GERADOS E ESTRUTURA:', 'ARQUIVOS DESTINO GERADOS:', '{"  Compressão Usada:".ljust(29)}SNAPPY',
                 repeat('-', 70), repeat('-', 70), repeat('-', 70), repeat('-', 70)]) AS linha FROM a),
        csv AS (SELECT nome_original, unnest(['CONFIGURAÇÃO CSV DETECTADA:', '{"  Encoding:".ljust(29)}utf-8-sig',
                 '{"  Separador:".ljust(29)},', repeat('-', 70)]) AS linha FROM a WHERE vez = 0),
        colunas AS (SELECT nome_original, unnest(['  Mapeamento de Colunas:', '  Tipos de Campos Inferidos no Parquet:']) AS linha FROM a WHERE vez <> 3),
        erros AS (SELECT nome_original, unnest(['ERROS OCORRIDOS DURANTE O PROCESSO:', '  - ' || erro, repeat('-', 70)]) AS linha FROM a WHERE erro IS NOT NULL)
        SELECT nome_original, '{"Status Final:".ljust(29)}' || CASE status WHEN 'sucesso' THEN '✅ SUCESSO'
                 WHEN 'erro' THEN '❌ ERRO' ELSE '⚠️ SUCESSO COM ALERTAS' END AS linha FROM a
        UNION ALL FROM fixas UNION ALL FROM csv UNION ALL FROM colunas UNION ALL FROM erros
        UNION ALL SELECT nome_original, '{"  Nome:".ljust(29)}' || nome_original FROM a
        UNION ALL SELECT nome_original, '{"  Formato Detectado:".ljust(29)}' || upper(formato) FROM a
        UNION ALL SELECT nome_original, '{"  Tamanho:".ljust(29)}' || bytes || ' bytes' FROM a
        UNION ALL SELECT nome_original, '{"  SHA-256 Hash:".ljust(29)}' || hash FROM a
        UNION ALL SELECT nome_original, '{"  Total de Linhas Lidas:".ljust(29)}' || CASE WHEN status = 'erro' THEN 0 ELSE linhas_lidas END FROM a
        UNION ALL SELECT nome_original, '{"  Total de Colunas Lidas:".ljust(29)}' || CASE WHEN vez = 3 THEN 0 ELSE 3 END FROM a
        UNION ALL SELECT nome_original, '    - ''' || o || '''' || CASE WHEN o <> f THEN ' -> ''' || f || '''' ELSE '' END
                  FROM a, cols WHERE vez <> 3
        UNION ALL SELECT nome_original, '    - ' || f || ': ' || t FROM a, cols WHERE vez <> 3
        UNION ALL SELECT nome_original, unnest(['LINHAS INVÁLIDAS PULADAS (NDJSON/JSONL) - Total: ' || ndjson_total_invalidas || ':', repeat('-', 70)])
                  FROM a WHERE ndjson_total_invalidas > 0
        UNION ALL SELECT nome_original, '  - Linha ' || pos || ': JSON inválido' FROM r
        UNION ALL SELECT nome_original, '    Conteúdo: ' || linha_fonte FROM r
        UNION ALL SELECT nome_original, '  - ... e mais linhas inválidas (veja o relatório JSON para detalhes)'
                  FROM a WHERE ndjson_total_invalidas > 10""",
    "fault_policy": f"""
        WITH {_BASE}, f AS (SELECT *, vez = 3 OR (vez = 2 AND ruins > 0) AS falha FROM s),
        stop AS (SELECT coalesce(min(bloco) FILTER (falha), 1000000000000) AS fim FROM f)
        SELECT nome_original, CASE WHEN falha THEN 'erro' ELSE 'sucesso' END AS status,
               CASE WHEN falha AND vez = 2 THEN CAST(primeira AS VARCHAR) WHEN falha THEN '' END AS linha,
               CASE WHEN NOT falha THEN n END AS escritas
        FROM f, stop WHERE bloco <= fim""",
    "stop_in_waves": f"""
        WITH c AS (SELECT c_custkey, c_custkey // {WAVE_BLOCK} AS bloco, c_custkey * 3 > 2 * (SELECT max(c_custkey) FROM customer) AS ruim,
                          row_number() OVER (PARTITION BY c_custkey // {WAVE_BLOCK} ORDER BY c_custkey) AS pos FROM customer),
        b AS (SELECT bloco, count(*) AS n, sum(c_custkey) AS soma, min(pos) FILTER (ruim) AS primeira FROM c GROUP BY bloco)
        SELECT 'onda_' || printf('%08d', bloco) || '.jsonl' AS nome_original,
               CASE WHEN primeira IS NULL THEN 'sucesso' ELSE 'erro' END AS status, CAST(primeira AS VARCHAR) AS linha,
               CASE WHEN primeira IS NULL THEN n END AS escritas, CASE WHEN primeira IS NULL THEN CAST(soma AS BIGINT) END AS soma
        FROM b WHERE bloco <= (SELECT coalesce(min(bloco) FILTER (primeira IS NOT NULL), max(bloco)) FROM b)""",
    "inferred_types": """
        SELECT coluna, tipo, (SELECT count(*) FROM lineitem) AS linhas FROM (VALUES
          ('l_orderkey', 'Int64'), ('l_partkey', 'Int64'), ('l_suppkey', 'Int64'), ('l_linenumber', 'Int64'),
          ('l_quantity', 'Float64'), ('l_extendedprice', 'Float64'), ('l_discount', 'Float64'), ('l_tax', 'Float64'),
          ('l_returnflag', 'String'), ('l_linestatus', 'String'), ('l_shipdate', 'String')) AS t(coluna, tipo)""",
}
