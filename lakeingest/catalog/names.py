"""Queries on names and values: normalisation, identifier and coordinate rules, file properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.catalog.samples import blocks, fresh, table, write_files, write_lines
from lakeingest.functions import files as ff
from lakeingest.functions import names as nm
from lakeingest.functions.values import coordinate_value, id_text
from lakeingest.operators.framing import write_parquet
from lakeingest.options import IngestOptions
from lakeingest.plans.ingest import ingest
from lakeingest.session import qualified
from lakeingest.sources.listing import list_files, list_sources, sniff, validate_sources
from lakeingest.sources.remote import hash_files

NAMED_ROWS = 500
_EXTENSIONS = "'csv', 'XLSX', 'json', 'ndjson', 'JsonL', 'parquet', 'txt', 'CSV'"
_SENSITIVE = "'CPF', ' Código ', 'INSCRIÇÃO', 'titulo eleitoral', 'Título_Eleitoral', 'CPF/CNPJ', 'Seção', 'nome'"
_COORDINATES = "'Latitude', 'lat_obs', 'platô', ' LNG ', 'x_lon', 'flat', 'Longitúde_GPS', 'lonja', 'lng', 'minha_lat'"


def pick(array: str, c: str):
    """One of the listed names, by the column's value."""
    return F.expr(f"element_at(array({array}), cast({c} % size(array({array})) as int) + 1)")


def extension_of(lang):
    return (
        F.when(lang == "en", ".csv").when(lang == "fr", ".JSON").when(lang == "es", ".jsonl").otherwise(".txt")
    )


def document_files(spark: SparkSession, sf_dir: str, folder: str, other: str = ".txt") -> str:
    """One file per document, its text as content; ``other`` ends the names of German ones."""
    docs = table(spark, sf_dir, "documents")
    ending = F.when(F.col("lang") == "de", other).otherwise(extension_of(F.col("lang")))
    name = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), ending)
    return write_files(docs.select(name.alias("name"), F.encode("text", "UTF-8").alias("content")), folder)


def below(folder: str):
    return F.regexp_extract("path", r"/arquivos/(.*)$", 1)


def list_sources_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = document_files(spark, sf_dir, fresh(spark, "list_sources") + "/arquivos")
    found = list_sources(spark, [folder, f"{folder}/src0", f"{folder}/nada"])
    return found.select(below(folder).alias("arquivo"), "format", "length")


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("lago.v1/"), F.col("page_id").cast("string"), F.lit("."), pick(_EXTENSIONS, "page_id"))
    return table(spark, sf_dir, "pages").select(
        "page_id", ff.detect_format(path).alias("formato"), ff.file_extension(F.col("url")).alias("extensao_url")
    )


def validate_sources_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are written empty, low-quality ones not at all; folders are asked for too."""
    root = fresh(spark, "validate_sources") + "/arquivos"
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    name = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), extension_of(F.col("lang")))
    docs = docs.withColumn("name", name)
    content = F.when(F.coalesce("toxic", F.lit(0)) == 1, "").otherwise(F.col("text"))
    write_files(
        docs.where("coalesce(quality, 1) = 1").select("name", F.encode(content, "UTF-8").alias("content")), root
    )
    base = qualified(spark, root)
    expected = docs.select(F.concat(F.lit(base + "/"), "name").alias("path")).unionByName(
        docs.select(F.concat(F.lit(base + "/"), "source").alias("path")).distinct()
    )
    checked = validate_sources(expected, list_files(spark, [root]))
    return checked.select(
        F.regexp_extract("path", r"/arquivos/(.*)$", 1).alias("arquivo"),
        F.regexp_extract("erro", r"^([^:]*):", 1).alias("problema"),
    )


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = document_files(spark, sf_dir, fresh(spark, "content_hash") + "/arquivos", ".ndjson")
    return hash_files(list_sources(spark, [folder])).select(below(folder).alias("arquivo"), "hash_sha256")


def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French and German texts as single-byte data, the rest as UTF-8."""
    data = F.when(F.col("lang").isin("fr", "de"), ff.encode_single_byte(F.col("text"))).otherwise(
        F.encode("text", "UTF-8")
    )
    return table(spark, sf_dir, "documents").select("doc_id", ff.detect_encoding(data).alias("encoding"))


def sniff_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ff.sniff_delimiter(F.col("text")).alias("sep"))


def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", nm.strip_accents_col(F.lower("text")).alias("texto")
    )


def slug_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", nm.normalize_name_col(F.col("text")).alias("nome")
    )


def normalize_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles as headers."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", nm.normalize_name_col(title).alias("nome"))


def normalize_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every turn as one header."""
    words = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "palavra")
    )
    based = words.withColumn("base", nm.normalize_name_col(F.col("palavra")))
    named = nm.dedupe_table(based, ["conv_id", "turn"], "pos", "base", "nome")
    return named.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "nome")


def candidate_names(spark: SparkSession, sf_dir: str, listed: str) -> DataFrame:
    """Names for the predicates: listed ones by part, alone and joined to a part's first word, and every word of the conversations."""
    part = table(spark, sf_dir, "part").withColumn("nome", pick(listed, "p_partkey"))
    joined = part.select(F.concat_ws("_", F.split_part("p_name", F.lit(" "), F.lit(1)), "nome").alias("nome"))
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "[ \n]+")).alias("nome"))
    return part.select("nome").unionByName(joined).unionByName(words).groupBy("nome").agg(F.count(F.lit(1)).alias("n"))


def sensitive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_names(spark, sf_dir, _SENSITIVE).select("nome", "n", nm.is_sensitive_col(F.col("nome")).alias("sensivel"))


def coordinate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_names(spark, sf_dir, _COORDINATES).select("nome", "n", nm.is_coordinate_col(F.col("nome")).alias("coordenada"))


def coordinate_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preset turns padded comma decimals into numbers and unreadable ones into null."""
    folder = fresh(spark, "coordinate_cast")
    text = F.concat(F.lit("  "), F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")), F.lit(" "))
    lat = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "invalido").when(
        F.col("c_mktsegment") == "BUILDING", "").otherwise(text)
    rows = table(spark, sf_dir, "customer").select(
        F.concat_ws(";", F.col("c_custkey").cast("string"), lat, "c_name").alias("value")
    )
    files = write_lines(rows, f"{folder}/pontos", "csv", "Chave;LATITUDE;Rua")
    options = IngestOptions(preset="bi", hash_sources=False)
    return ingest(spark, [files], f"{folder}/out", options).table()


def coordinate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", coordinate_value(text).alias("valor")
    )


def float_to_id_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", id_text(F.col("l_quantity")).alias("inteiro"),
        id_text(F.col("l_extendedprice") * 1000).alias("grande"), id_text(F.col("l_discount")).alias("fracao"),
    )


def output_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a fixed number of rows, many of which share a base name: datasets of two runs, one of
    which lets the last path of a name overwrite the others."""
    folder = fresh(spark, "output_names")
    orders = table(spark, sf_dir, "orders").withColumn("value", F.col("o_orderkey").cast("string"))
    parts = blocks(orders, "o_orderkey", NAMED_ROWS)
    name = F.format_string("d%06d/nome%d.csv", F.col("bloco"), F.col("bloco") * F.col("bloco") % 7)
    files = write_files(parts.select(name.alias("name"), F.concat(F.lit("k\n"), "body").alias("content")), f"{folder}/nomes")
    run = lambda how: ingest(spark, [files], f"{folder}/{how}", IngestOptions(collision=how, hash_sources=False))
    hashed, kept = run("hash"), run("overwrite")
    audit = hashed.audit.select(
        F.regexp_extract("caminho_original", r"/nomes/(.*)$", 1).alias("arquivo"), "linhas_lidas",
        F.regexp_extract(F.get("caminho_parquet_gerado", F.lit(0)), r"lake_source=(.*)$", 1).alias("dataset"))
    parts_of = F.regexp_extract("dataset", r"^(.*?)(__[0-9a-f]{32})?\.parquet$", 1).alias("base")
    alone = audit.groupBy("dataset").agg(F.count(F.lit(1)).alias("donos"))
    left = kept.table(keep_source=True).groupBy("lake_source").agg(F.min("k").alias("k"))
    ends = left.select(F.floor(F.col("k") / NAMED_ROWS).alias("bloco"), F.col("lake_source").alias("sobrescrito"))
    return audit.join(alone, "dataset").withColumn("bloco", F.substring("arquivo", 2, 6).cast("bigint")).join(ends, "bloco", "left").select(
        "arquivo", "linhas_lidas", parts_of, F.col("dataset").rlike("__[0-9a-f]{32}").alias("com_hash"), "donos", "sobrescrito")


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "parquet_roundtrip")
    lines = table(spark, sf_dir, "lineitem")
    parts = []
    for codec in ("snappy", "ZSTD", "none", "outro"):
        write_parquet(lines, f"{folder}/{codec}", codec)
        back = spark.read.parquet(f"{folder}/{codec}")
        parts.append(back.agg(
            F.lit(codec).alias("codec"), F.count(F.lit(1)).alias("linhas"),
            F.round(F.sum("l_quantity"), 2).alias("quantidade"), F.max("l_shipdate").alias("ultimo"),
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def sniff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of one file per document: encoding, delimiter and header of the CSV ones."""
    folder = document_files(spark, sf_dir, fresh(spark, "sniff_files") + "/arquivos")
    seen = sniff(list_sources(spark, [folder])).where("format = 'csv' and erro is null")
    return seen.select(
        below(folder).alias("arquivo"), "encoding", "sep",
        F.regexp_replace("layout", r"(?s)\n.*$", "").alias("cabecalho"),
    )


QUERIES = {
    "list_sources": list_sources_query, "detect_format": detect_format,
    "validate_sources": validate_sources_query, "content_hash": content_hash,
    "detect_encoding": detect_encoding, "sniff_delimiter": sniff_delimiter, "sniff_files": sniff_files,
    "strip_accents": strip_accents, "slug_values": slug_values, "normalize_headers": normalize_headers,
    "normalize_dedupe": normalize_dedupe, "sensitive_columns": sensitive_columns,
    "coordinate_columns": coordinate_columns, "coordinate_cast": coordinate_cast,
    "coordinate_values": coordinate_values, "float_to_id_text": float_to_id_text,
    "output_names": output_names_query, "parquet_roundtrip": parquet_roundtrip,
}


def _slug(c: str) -> str:
    return rf"""CASE WHEN coalesce({c}, '') = '' THEN 'coluna_sem_nome' ELSE coalesce(nullif(trim(
        regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(
        trim(lower({c}), ' ' || chr(9) || chr(10)), 'e[-_]mail', 'email', 'g')), '[\s\x0b\x1c-\x1f\x85\x{{A0}}\-/\\]+', '_', 'g'),
        '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_'), ''), 'coluna') END"""


def _names(array: str, key: str) -> str:
    return f"list_extract([{array}], CAST({key} % len([{array}]) AS INT) + 1)"


def _candidates(listed: str) -> str:
    return rf"""
        p AS (SELECT p_name, {_names(listed, 'p_partkey')} AS nome FROM part),
        c AS (SELECT nome, count(*) AS n FROM (
            SELECT nome FROM p UNION ALL SELECT split_part(p_name, ' ', 1) || '_' || nome FROM p
            UNION ALL SELECT unnest(regexp_split_to_array(text, '[ \n]+')) FROM conversations) GROUP BY nome)"""


_DOC_NAME = (
    "source || '/doc_' || doc_id || CASE lang WHEN 'en' THEN '.csv' WHEN 'fr' THEN '.JSON' "
    "WHEN 'es' THEN '.jsonl' ELSE '.txt' END"
)
_SNIFF = r"""
        lines AS (SELECT doc_id, list_filter(list_transform(
            regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'),
            lambda x: trim(x, ' ' || chr(9) || chr(160))), lambda x: x <> '')[1:5] AS l FROM documents),
        n AS (SELECT doc_id,
            coalesce(list_sum(list_transform(l, lambda x: length(x) - length(replace(x, ',', '')))), 0) AS a,
            coalesce(list_sum(list_transform(l, lambda x: length(x) - length(replace(x, ';', '')))), 0) AS b,
            coalesce(list_sum(list_transform(l, lambda x: length(x) - length(replace(x, chr(9), '')))), 0) AS c,
            coalesce(list_sum(list_transform(l, lambda x: length(x) - length(replace(x, '|', '')))), 0) AS d FROM lines),
        s AS (SELECT doc_id, CASE WHEN a >= greatest(b, c, d) THEN ',' WHEN b >= greatest(c, d) THEN ';'
            WHEN c >= d THEN chr(9) ELSE '|' END AS sep FROM n)"""

ORACLE = {
    "list_sources": f"""
        SELECT {_DOC_NAME} AS arquivo, CASE lang WHEN 'en' THEN 'csv' WHEN 'fr' THEN 'json' ELSE 'jsonl' END AS format,
               octet_length(encode(text)) AS length FROM documents WHERE lang IN ('en', 'fr', 'es')""",
    "detect_format": rf"""
        SELECT page_id, CASE WHEN lower({_names(_EXTENSIONS, 'page_id')}) IN ('csv', 'xlsx', 'json', 'ndjson', 'jsonl')
                 THEN lower({_names(_EXTENSIONS, 'page_id')}) END AS formato,
               regexp_extract(lower(url), '[^/\\]\.([^./\\]+)$', 1) AS extensao_url FROM pages""",
    "validate_sources": f"""
        SELECT {_DOC_NAME} AS arquivo,
               CASE WHEN quality = 0 THEN 'Arquivo não encontrado'
                    WHEN lang NOT IN ('en', 'fr', 'es') THEN 'Formato não suportado'
                    WHEN toxic = 1 OR text = '' THEN 'Arquivo vazio (0 bytes)' END AS problema
        FROM documents LEFT JOIN labels USING (doc_id)
        UNION ALL
        SELECT source, CASE WHEN min(coalesce(quality, 1)) = 0 AND max(coalesce(quality, 1)) = 0
                 THEN 'Arquivo não encontrado' ELSE 'O caminho não é um arquivo' END
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "content_hash": f"""
        SELECT CASE lang WHEN 'de' THEN source || '/doc_' || doc_id || '.ndjson' ELSE {_DOC_NAME} END AS arquivo,
               sha256(text) AS hash_sha256 FROM documents""",
    "detect_encoding": r"""
        SELECT doc_id, CASE WHEN lang IN ('fr', 'de') AND regexp_matches(text, '[^\x00-\x7F]')
                 THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding FROM documents""",
    "sniff_delimiter": f"WITH {_SNIFF} SELECT * FROM s",
    "sniff_files": rf"""
        WITH {_SNIFF}
        SELECT {_DOC_NAME} AS arquivo, 'utf-8-sig' AS encoding, sep,
               regexp_extract(text, '^(?:[ \t\r]*\n)*([^\n]*)', 1) AS cabecalho
        FROM documents JOIN s USING (doc_id) WHERE lang = 'en' AND text <> ''""",
    "strip_accents": "SELECT doc_id, strip_accents(lower(text)) AS texto FROM documents",
    "slug_values": f"SELECT conv_id, turn, {_slug('text')} AS nome FROM conversations",
    "normalize_headers": f"""
        SELECT page_id, {_slug('titulo')} AS nome
        FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS titulo FROM pages)""",
    "normalize_dedupe": f"""
        WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS palavra,
                          generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations),
        b AS (SELECT *, {_slug('palavra')} AS base FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, base ORDER BY pos) - 1 AS n FROM b)
        SELECT conv_id, turn, pos, CASE WHEN n = 0 THEN base ELSE base || '_' || n END AS nome FROM r""",
    "sensitive_columns": f"""
        WITH {_candidates(_SENSITIVE)}
        SELECT nome, n, strip_accents(lower(trim(nome))) IN ({', '.join(f"'{x}'" for x in sorted(nm.SENSITIVE_NAMES))}) AS sensivel FROM c""",
    "coordinate_columns": f"""
        WITH {_candidates(_COORDINATES)}
        SELECT nome, n, regexp_matches(strip_accents(lower(trim(nome))), '{nm.COORDINATE_PATTERN}') AS coordenada FROM c""",
    "coordinate_cast": """
        SELECT c_custkey AS chave, CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'BUILDING') THEN c_acctbal END AS latitude,
               c_name AS rua FROM customer""",
    "coordinate_values": "SELECT l_orderkey, l_linenumber, l_extendedprice AS valor FROM lineitem",
    "float_to_id_text": """
        WITH t AS (SELECT *, l_extendedprice * 1000 AS big FROM lineitem)
        SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS inteiro,
               CASE WHEN big % 1 = 0 THEN CAST(CAST(big AS BIGINT) AS VARCHAR) ELSE CAST(big AS VARCHAR) END AS grande,
               CASE WHEN l_discount % 1 = 0 THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR)
                    ELSE CAST(l_discount AS VARCHAR) END AS fracao FROM t""",
    "output_names": f"""
        WITH b AS (SELECT o_orderkey // {NAMED_ROWS} AS bloco, count(*) AS linhas_lidas FROM orders GROUP BY ALL),
        p AS (SELECT *, 'nome' || (bloco * bloco % 7) AS base FROM b),
        s AS (SELECT base, count(*) AS n, max(bloco) AS ultimo FROM p GROUP BY base)
        SELECT 'd' || printf('%06d', bloco) || '/' || base || '.csv' AS arquivo, linhas_lidas, base, n > 1 AS com_hash,
               1 AS donos, CASE WHEN bloco = ultimo THEN base || '.parquet' END AS sobrescrito FROM p JOIN s USING (base)""",
    "parquet_roundtrip": """
        SELECT codec, count(*) AS linhas, round(sum(l_quantity), 2) AS quantidade, max(l_shipdate) AS ultimo
        FROM lineitem, (VALUES ('snappy'), ('ZSTD'), ('none'), ('outro')) AS c(codec) GROUP BY codec""",
}
