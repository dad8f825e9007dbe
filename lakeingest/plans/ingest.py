"""One ingestion run: list, sniff, read every layout, write datasets, quarantine and audit."""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.functions.files import HEAD_BYTES, base_name, decode_head
from lakeingest.functions.names import trim_all
from lakeingest.operators.framing import (
    NAME_DIGITS, SOURCE, Layout, Outcome, colliding_names, escaped_partition, named, plain_uri, sheet_uri,
)
from lakeingest.operators.jsonshape import strict_variant
from lakeingest.options import IngestOptions
from lakeingest.plans.audit import AUDIT_FIELDS, first_invalid, status_of
from lakeingest.session import (
    few_listings, few_tasks, has_data, isolated, move_tree, partition_folder, qualified, remove_tree, spread, work_folder,
)
from lakeingest.sources.delimited import ingest_delimited
from lakeingest.sources.listing import given_sources, list_sources, sniff
from lakeingest.sources.records import ingest_json
from lakeingest.sources.remote import hash_files, read_heads, remove_folders
from lakeingest.sources.workbooks import ingest_workbooks

CONCURRENT_LAYOUTS = 8
NO_RECORDS = "Nenhum registro válido encontrado no arquivo"
# A document is one value in one row, which the engine's VARIANT limits to 128 MB. Larger ones are cut
# into their records by many tasks first.
MAX_DOCUMENT_BYTES = 120 * 1024 * 1024


@dataclass
class IngestResult:
    """Where a run left its tables. All of them are read back lazily."""

    spark: SparkSession
    outcomes: list[Outcome]
    audit_folder: str
    quarantine_folder: str

    @property
    def audit(self) -> DataFrame:
        return self.spark.read.parquet(self.audit_folder)

    @property
    def quarantine(self) -> DataFrame:
        schema = "path string, line_number bigint, content string, error string"
        if not qualified(self.spark, self.quarantine_folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.quarantine_folder)

    @property
    def folders(self) -> list[str]:
        return [o.folder for o in self.outcomes if o.folder]

    def table(self, keep_source: bool = False) -> DataFrame:
        """Rows of all layouts by column name; ``lake_source`` tells the dataset of each row.

        Where layouts disagree about a column's type, numbers become doubles and all else text.
        """
        with few_listings(self.spark):
            tables = [(self.spark.read.parquet(o.folder), o.source) for o in self.outcomes if o.folder]
        tables = [(few_tasks(df, df), source) for df, source in tables]
        if not keep_source:
            tables = [(df.drop(source), None) for df, source in tables]
        elif any(SOURCE in df.columns and source != SOURCE for df, source in tables):
            raise ValueError(f"a source has a column {SOURCE}: read the folders one by one")
        else:
            tables = [(df.withColumnRenamed(source, SOURCE), None) for df, source in tables]
        return _widened([df for df, _ in tables])


def _widened(tables: list[DataFrame]) -> DataFrame:
    """Union by column name; columns whose types differ are cast to a common one first."""
    kinds: dict[str, set[str]] = {}
    for df in tables:
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    wide = {n: "double" if k <= {"int", "bigint", "double"} else "string" for n, k in kinds.items() if len(k) > 1}

    def cast(df: DataFrame) -> DataFrame:
        out = []
        for name, kind in df.dtypes:
            c = F.col("`" + name.replace("`", "``") + "`")
            nested = kind.startswith(("struct", "array", "map"))
            if name in wide and kind != wide[name]:
                c = (F.to_json(c) if nested else c.cast(wide[name])).alias(name)
            out.append(c)
        return df.select(*out)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cast, tables))


def _route(sources: DataFrame, limit: int) -> DataFrame:
    """How a source is read. A ``.json`` file is a document unless its first line is already a whole
    value and more follows, which makes it line-delimited."""
    text = F.ltrim(F.col("text"), F.lit("﻿ \t\r\n"))
    cut = F.locate("\n", text)
    first, rest = trim_all(F.left(text, cut - 1)), trim_all(F.substr(text, cut + 1))
    more = (rest != "") | (F.col("length") > HEAD_BYTES)
    is_lines = (cut > 0) & more & strict_variant(first).isNotNull()
    return sources.withColumn(
        "route",
        F.when(F.col("format") != "json", F.col("format"))
        .when(F.coalesce(is_lines, F.lit(False)), "json-lines")
        .when(F.col("length") > limit, "json-large")
        .otherwise("json-document"),
    )


def ingest(
    spark: SparkSession,
    roots: Iterable[str] | DataFrame,
    out: str,
    opts: IngestOptions = IngestOptions(),
    run: str = "0",
) -> IngestResult:
    """Convert every supported file below ``roots``, or listed in a table ``(path, length)``, into Parquet below ``out``.

    Writes ``out/dados/lote=<run>/layout=<id>/lake_source=<name>.parquet``, one quarantine table and
    one audit table per run. The driver handles one small row per layout plus the file paths a
    scan's file index needs anyway; file content stays on the executors.

    With ``continue_on_error`` off the files are converted in waves in path order, which begin with ``wave_files`` and
    grow (``in_waves``), and no wave begins behind one with a failing file. Each wave's audit rows are written before the next one begins.
    """
    opts, inner, work = opts.resolve(), isolated(spark), work_folder(spark, "run")
    try:
        return IngestResult(spark, *_ingest(inner, roots, out, opts, run, work))
    finally:  # nothing of a result is read from there
        remove_tree(inner, work)


def _ingest(inner: SparkSession, roots, out: str, opts: IngestOptions, run: str, work: str) -> tuple[list[Outcome], str, str]:
    started = time.time()
    data = f"{out}/dados/lote={run}"
    remove_tree(inner, data)  # a run replaces what the same run wrote before

    limit = MAX_DOCUMENT_BYTES if opts.document_bytes is None else opts.document_bytes
    if isinstance(roots, DataFrame):
        roots.select("path", "length").write.parquet(f"{work}/listed")
        listed = given_sources(inner.read.parquet(f"{work}/listed"))
    else:
        listed = list_sources(inner, roots)
    # The paths are small rows, which would all be sniffed by one task.
    _route(sniff(spread(listed, "path")), limit).withColumn(
        "layout_id",
        F.substr(F.sha2(F.concat_ws("\u001e", "route", "encoding", "sep", "layout"), 256), F.lit(1), F.lit(12)),
    ).drop("head", "header_rest", "text", "read_error").write.mode("overwrite").parquet(f"{work}/sources")
    sources = inner.read.parquet(f"{work}/sources")
    # One small row per file: the paths every scan's file index holds on the driver in any case.
    files = sources.select("layout_id", "path", "format", F.col("erro").isNotNull().alias("bad")).collect()
    if not opts.continue_on_error and (wrong := [f.path for f in files if f.bad]):
        sources = sources.where(F.col("path") <= min(wrong))
        files = [f for f in files if f.path <= min(wrong)]
    overwrite = opts.collision == "overwrite"  # the last path of a base name keeps the plain name
    colliding = colliding_names(sources.where("erro is null"), f"{work}/shared-names", overwrite)
    quarantine = f"{out}/quarentena/lote={run}"
    remove_tree(inner, quarantine)

    waves = [files] if opts.continue_on_error else in_waves(files, opts.wave_files)
    outcomes, one = [], len(waves) == 1
    folder = f"{out}/auditoria/lote={run}"
    direct = one and opts.continue_on_error and not overwrite  # nothing can change the rows afterwards
    for k, wave in enumerate(waves):
        here, mark, at = sources, "", f"{work}/wave-{k:06d}"
        if not one:
            mark = f"w{k}" if k else ""  # layouts of a wave have folders of their own
            here = sources.where(F.col("path").between(wave[0].path, wave[-1].path)).withColumn("layout_id", F.concat("layout_id", F.lit(mark)))
        found, kept = _convert(inner, here.where("erro is null"), [f for f in wave if not f.bad], opts, data, at, colliding, mark)
        outcomes += found
        rows = _audit_rows(inner, here, found, kept, colliding, opts, data, quarantine, started)
        rows.select(*AUDIT_FIELDS).write.mode("overwrite").parquet(folder if direct else f"{work}/audit/{k:06d}")
        if not direct and not opts.continue_on_error:
            failed = inner.read.parquet(f"{work}/audit/{k:06d}").where("status = 'erro'").limit(1).count()
            if failed:
                waves = waves[:k + 1]
                break
    if not direct:
        rows = inner.read.parquet(*[f"{work}/audit/{k:06d}" for k in range(len(waves))])
        _settle(inner, rows, opts, overwrite).select(*AUDIT_FIELDS).write.mode("overwrite").parquet(folder)
    for o in outcomes:  # the stop and collision rules may have emptied a layout
        o.folder = o.folder if o.folder and has_data(inner, o.folder) else None
    return outcomes, folder, quarantine


def in_waves(files: list, size: int) -> list[list]:
    """The files in path order, ``size`` to a wave until half the files before a wave are more, then that many; a batch
    without files is one empty wave.

    So the number of waves grows with the logarithm of the files, and a failing wave costs at most half of what is kept.
    """
    ordered = sorted(files, key=lambda f: f.path)
    waves, at = [], 0
    while at < len(ordered):
        waves.append(ordered[at : at + max(size, at // 2)])
        at += len(waves[-1])
    return waves or [[]]


def _convert(inner, usable: DataFrame, files: list, opts, data: str, work: str, colliding, mark: str):
    """Read and write the usable files of one wave; returns the outcomes and the processed sheets."""
    outcomes = []
    by_layout: dict[str, list[str]] = {}
    for f in files:
        if f.format != "xlsx":
            by_layout.setdefault(f.layout_id + mark, []).append(f.path)
    # One file stands for its layout: only the heads of those are read again and kept.
    labels = usable.where("format != 'xlsx'").groupBy("layout_id").agg(
        *[F.first(c).alias(c) for c in ("format", "route", "encoding", "sep", "layout")],
        F.min("path").alias("path"), F.min_by("length", "path").alias("length"),
    )
    labels = read_heads(labels).withColumn(
        "text", F.when(F.col("format") == "csv", decode_head(F.col("head"), F.col("encoding"))).otherwise(
            F.make_valid_utf8(F.col("head").cast("string")))
    ).drop("head", "header_rest")

    def read(row) -> list[Outcome]:
        layout = Layout(
            row.layout_id, row.format, sorted(by_layout[row.layout_id]), row.encoding, row.sep,
            row.layout, row.text, row.length > HEAD_BYTES,
        )
        return _read_layout(inner, layout, row.route, opts, data, work, colliding)

    # Layouts are independent jobs: submitting several keeps the executors busy between them.
    with ThreadPoolExecutor(CONCURRENT_LAYOUTS) as pool:
        for found in pool.map(read, labels.orderBy("layout_id").collect() if by_layout else []):
            outcomes += found

    kept = None
    books = [f.path for f in files if f.format == "xlsx"]
    if books:
        try:
            found, kept = ingest_workbooks(inner, usable.where("format = 'xlsx'"), opts, data, work, colliding, mark)
            outcomes += found
        except Exception as e:  # listing the sheets failed as a whole; a bad book or layout is an outcome
            outcomes.append(_all_failed(inner, "xlsx", books, e))
    for o in outcomes:
        o.folder = o.folder if o.folder and has_data(inner, o.folder) else None
    return outcomes, kept


def _read_layout(inner, layout: Layout, route: str, opts, data, work, colliding) -> list[Outcome]:
    """Read one layout. When that fails, files that cannot be read are found in one pass over the files,
    and the others are read once more; a fault of the layout itself fails all its files at once."""

    def attempt(paths: list[str]) -> list[Outcome]:
        try:
            of = replace(layout, paths=paths)
            if route == "csv":
                return ingest_delimited(inner, of, opts, data, work, colliding)
            return ingest_json(inner, of, opts, data, work, colliding, route)
        except Exception:
            remove_tree(inner, f"{data}/layout={layout.id}")
            raise

    try:
        return attempt(layout.paths)
    except ValueError as e:
        return [_all_failed(inner, layout.id, layout.paths, e)]
    except Exception as e:
        paths = inner.createDataFrame([(p,) for p in layout.paths], "path string")
        unread = hash_files(spread(paths, "path")).where("hash_sha256 = 'indisponivel'").select("path")
        bad = {r.path for r in unread.collect()}
        good = [p for p in layout.paths if p not in bad]
        if not bad or not good:
            return [_all_failed(inner, layout.id, layout.paths, e)]
        outcomes = [_all_failed(inner, layout.id, sorted(bad), e)]
        try:
            return outcomes + attempt(good)
        except Exception as again:
            return outcomes + [_all_failed(inner, layout.id, good, again)]


def _all_failed(inner, layout: str, paths: list[str], error: Exception) -> Outcome:
    from lakeingest.sources.remote import scan_uri

    message = str(error).split("\n\nJVM stacktrace")[0].strip()
    failed = inner.createDataFrame([(scan_uri(p), message) for p in paths], "uri string, erro string")
    return Outcome(layout, failed=failed)


def _audit_rows(inner, sources, outcomes, kept, colliding, opts, data, quarantine, started) -> DataFrame:
    """The audit rows of one wave, whose invalid lines are written to the quarantine."""
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    none = lambda schema: inner.createDataFrame([], schema)

    parts = [o.invalid for o in outcomes if o.invalid is not None]
    if parts:
        union(parts).select(
            plain_uri(F.col("uri")).alias("path"), "line_number", "content", "error"
        ).write.mode("append").parquet(quarantine)
    failed = [o.failed for o in outcomes if o.failed is not None]
    # One scan over the datasets per partition column; only their folders and row counts are read.
    written = [o for o in outcomes if o.folder]
    scan = lambda source: inner.read.schema(f"layout string, {source} string").option("basePath", data).parquet(
        *[o.folder for o in written if o.source == source])
    counts = union([
        few_tasks(found := scan(source), found)
        .groupBy(F.col("layout").alias("outcome"), F.col(source).alias("lake_source")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("column", F.lit(source))
        for source in sorted({o.source for o in written})
    ] or [none("outcome string, lake_source string, n bigint, column string")])
    counts = counts.withColumn("layout_id", F.substring_index("outcome", "-", 1)).withColumn(
        "folder", F.concat(F.lit(f"{data}/layout="), "outcome", F.lit("/"), "column"))

    plain = sources.where("format != 'xlsx'").select(
        F.col("uri").alias("at"), "uri", F.lit(0).alias("sheet_index"), F.lit(None).cast("string").alias("sheet"), "layout_id")
    if kept is not None:
        plain = plain.unionByName(kept.select(
            sheet_uri(F.col("uri"), F.col("dataset")).alias("at"), "uri", "sheet_index", "sheet", F.col("layout").alias("layout_id")))
    plain = named(plain, F.col("at"), colliding).drop("at")
    datasets = plain.join(counts, ["layout_id", "lake_source"], "left").groupBy("uri").agg(
        F.sum("n").alias("linhas_lidas"),
        F.min_by(F.coalesce("outcome", "layout_id"), "sheet_index").alias("outcome"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct(
                "sheet_index", F.concat("folder", F.lit("="), "lake_source").alias("at")
            )))), lambda s: s.at,
        ).alias("caminho_parquet_gerado"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("sheet").isNotNull(), F.struct("sheet_index", "sheet")))),
            lambda s: s.sheet,
        ).alias("xlsx_abas_processadas"),
    )
    meta = inner.createDataFrame(
        [(o.layout, o.original, o.final, o.types, dict(zip(o.original, o.final)) if opts.normalize else None)
         for o in outcomes if o.original],
        "outcome string, colunas_originais array<string>, colunas_finais array<string>, "
        "tipos_inferidos map<string,string>, mapa_normalizacao map<string,string>",
    )
    base = sources.select("path", "uri", "length", "format", "encoding", "sep", "layout_id", "erro")
    base = hash_files(spread(base, "path")) if opts.hash_sources else base.withColumn("hash_sha256", F.lit(""))
    if failed:
        base = base.join(union(failed).groupBy("uri").agg(F.min("erro").alias("late")), "uri", "left")
    else:
        base = base.withColumn("late", F.lit(None).cast("string"))
    shown = "array<struct<line_number:bigint,content:string,error:string>>"
    if parts:
        base = base.join(first_invalid(inner.read.parquet(quarantine), "path"), "path", "left")
    else:
        base = base.withColumn("n_invalid", F.lit(0)).withColumn("shown", F.lit(None).cast(shown))
    is_json = F.col("format").isin("json", "ndjson", "jsonl")
    empty = F.array().cast("array<string>")
    return (
        base.join(datasets, "uri", "left").join(meta, "outcome", "left")
        .withColumn("problem", F.coalesce(
            "erro", "late", F.when(is_json & F.col("linhas_lidas").isNull(), NO_RECORDS)
        ))
        .withColumn("erros", F.when(F.col("problem").isNull(), empty).otherwise(F.array("problem")))
        .withColumn("ndjson_total_invalidas", F.coalesce("n_invalid", F.lit(0).cast("bigint")))
        .select(
            F.regexp_extract("path", r"([^/]+)$", 1).alias("nome_original"),
            F.col("path").alias("caminho_original"),
            F.col("length").alias("tamanho_bytes"),
            F.coalesce("hash_sha256", F.lit("indisponivel")).alias("hash_sha256"),
            F.col("format").alias("formato_detectado"),
            F.current_timestamp().alias("data_hora_conversao"),
            status_of(F.col("erros"), F.col("ndjson_total_invalidas")).alias("status"),
            "erros",
            F.when(F.col("problem").isNull(), F.coalesce("caminho_parquet_gerado", empty)).otherwise(empty)
            .alias("caminho_parquet_gerado"),
            F.lit(opts.compression).alias("compressao_usada"),
            F.lit(round(time.time() - started, 4)).alias("tempo_processamento_segundos"),
            F.col("encoding").alias("csv_encoding"),
            F.col("sep").alias("csv_separador"),
            F.coalesce("xlsx_abas_processadas", empty).alias("xlsx_abas_processadas"),
            F.coalesce("shown", F.array().cast(shown)).alias("ndjson_linhas_invalidas"),
            "ndjson_total_invalidas",
            F.when(F.col("problem").isNull(), F.coalesce("linhas_lidas", F.lit(0))).otherwise(F.lit(0))
            .cast("bigint").alias("linhas_lidas"),
            F.greatest(F.size("colunas_originais"), F.lit(0)).alias("colunas_lidas"),
            F.coalesce("colunas_originais", empty).alias("colunas_originais"),
            F.coalesce("colunas_finais", empty).alias("colunas_finais"),
            "tipos_inferidos", "mapa_normalizacao",
        )
    )


def _settle(inner, rows: DataFrame, opts, overwrite: bool) -> DataFrame:
    """Apply the stop and collision rules to the stored audit rows of all waves."""
    if not opts.continue_on_error:
        # Within the failing wave: what lies behind the first failing path was never to be converted.
        stop = rows.where("status = 'erro'").agg(F.min("caminho_original")).first()[0]
        if stop is not None:
            _remove_datasets(inner, rows.where(F.col("caminho_original") > stop))
            rows = rows.where(F.col("caminho_original") <= stop)
    return _overwritten(inner, rows) if overwrite else rows


def _overwritten(inner, rows: DataFrame) -> DataFrame:
    """Of the files of a base name that gave data, the last one's stays, as ``<base>.parquet``.

    That file was written under this name from the start unless a later path failed or was never to be converted;
    only then is its folder renamed. The others were read for their audit rows, which now point to what stayed.
    """
    plain = F.regexp_replace("at", r"__[0-9a-f]{32}\.parquet$", ".parquet")
    live = rows.where(F.size("caminho_parquet_gerado") > 0).select(
        base_name(F.col("caminho_original")).alias("base"), "caminho_original", "caminho_parquet_gerado")
    last = live.groupBy("base").agg(
        F.count(F.lit(1)).alias("n"), F.max("caminho_original").alias("vencedor"),
        F.max_by("caminho_parquet_gerado", "caminho_original").alias("fica"))
    shared = live.join(last.where("n > 1").select("base", "vencedor"), "base")
    _remove_datasets(inner, shared.where("caminho_original <> vencedor").select("caminho_parquet_gerado"))
    # Names that several usable files share are hashed but for the planned keeper's, also where one alone gave data.
    usable = rows.groupBy(base_name(F.col("caminho_original")).alias("base")).agg(F.count(F.lit(1)).alias("sources"))
    hashed = F.sha2(F.col("vencedor"), 256).substr(1, NAME_DIGITS)
    late = last.join(usable.where("sources > 1"), "base").select("base", hashed.alias("mark"), F.explode("fica").alias("at"))
    late = late.where(F.col("at").endswith(F.concat(F.lit("__"), "mark", F.lit(".parquet")))).select("at", plain.alias("to"))
    for row in late.toLocalIterator():
        move_tree(inner, partition_folder(inner, row["at"]), partition_folder(inner, row["to"]))
    stays = last.select("base", F.transform("fica", lambda at: F.regexp_replace(at, r"__[0-9a-f]{32}\.parquet$", ".parquet")).alias("fica"))
    shared_names = usable.where("sources > 1").join(stays, "base").select("base", "fica")
    met = rows.withColumn("base", base_name(F.col("caminho_original"))).join(shared_names, "base", "left")
    here = F.when(F.size("caminho_parquet_gerado") > 0, F.coalesce("fica", "caminho_parquet_gerado")).otherwise(F.col("caminho_parquet_gerado"))
    return met.withColumn("caminho_parquet_gerado", here)


def _remove_datasets(inner, rows: DataFrame) -> None:
    """Tasks remove the datasets: one file of a base name or of a wave may stand for many."""
    at = rows.select(F.explode("caminho_parquet_gerado").alias("at"))
    remove_folders(spread(at.select(escaped_partition(F.col("at")).alias("path")), "path"))
