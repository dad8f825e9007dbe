"""JSON documents and line-delimited JSON.

Lines are scanned in splits. The schema is not inferred beforehand: the head of one file suggests
it, the layout is written with it, and the same pass aggregates the schema the data really has.
Only where the two differ is the layout written again.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.functions.names import trim_all
from lakeingest.operators import jsonshape as js
from lakeingest.operators.framing import Layout, Outcome, finish_columns, observed, write_layout
from lakeingest.options import IngestOptions
from lakeingest.session import literal_path
from lakeingest.sources.bigjson import document_units
from lakeingest.sources.lines import block_table, number_lines, read_lines
from lakeingest.sources.remote import scan_uri

LINE_FORMATS = ("ndjson", "jsonl")
CONTENT_CHARS = 100
#: Records of a table that suggest its schema, and the characters of the longest one that may.
FIRST_RECORDS, FIRST_CHARS = 20, 50_000
INVALID = "JSON inválido"
MALFORMED = "arquivo JSON malformado"


def clean(value, block=None):
    """Text with broken bytes replaced, without byte-order mark, trimmed."""
    text = F.make_valid_utf8(value)
    mark = text.startswith("﻿") if block is None else (block == 0) & text.startswith("﻿")
    return trim_all(F.when(mark, F.ltrim(text, F.lit("﻿"))).otherwise(text))


def json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Non-blank lines as ``(unit, uri, block, seq)``."""
    lines = read_lines(spark, paths)
    return lines.select(clean(F.col("value"), F.col("block")).alias("unit"), "uri", "block", "seq").where("unit != ''")


def json_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole documents as units; a text that is no single value is cut into its lines."""
    docs = spark.read.text([literal_path(p) for p in paths], wholetext=True).select(
        clean(F.col("value")).alias("doc"), F.col("_metadata.file_path").alias("uri")
    )
    lines = F.filter(
        F.transform(F.split("doc", r"\r\n|\r|\n"), lambda s: trim_all(s)), lambda s: s != ""
    )
    units = F.when(js.strict_variant(F.col("doc")).isNotNull(), F.array("doc")).otherwise(lines)
    return docs.select(F.explode(units).alias("unit"), "uri").select(
        "unit", "uri", F.lit(0).cast("bigint").alias("block"), F.monotonically_increasing_id().alias("seq")
    )


def checked(units: DataFrame, as_lines: bool) -> DataFrame:
    """Add ``v``, the VARIANT of a valid unit. A wrapped scalar must also be valid on its own."""
    if not as_lines:
        return js.with_strict_variant(units, F.col("unit"), "v")
    units = js.with_strict_variant(units, js.wrapped(F.col("unit")), "v")
    alone = js.is_object(F.col("unit")) | js.strict_variant(F.col("unit")).isNotNull()
    return units.withColumn("v", F.when(alone, F.col("v")))


def records(units: DataFrame, as_lines: bool) -> DataFrame:
    """One row per record: its text ``rec``, its VARIANT ``rv`` and its place ``(uri, seq, item)``.

    Invalid units keep one row with a null ``rec``.
    """
    if as_lines:
        rec = F.when(F.col("v").isNotNull(), js.wrapped(F.col("unit")))
        return units.withColumn("rec", rec).withColumn("rv", F.col("v")).withColumn("item", F.lit(0))
    texts = F.when(F.col("v").isNotNull(), js.record_texts(F.col("unit"), F.col("v"))).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    return (
        units.select(F.posexplode(texts).alias("item", "rec"), "uri", "block", "seq")
        .withColumn("rv", js.lenient_variant(F.col("rec")))
    )


def quarantine(spark: SparkSession, paths: list[str], units: DataFrame) -> DataFrame:
    """Invalid lines with their physical line number, and a shortened copy of their text.

    They are shortened before they meet the table of splits, so that no line of any length is shuffled.
    """
    blocks = block_table(read_lines(spark, paths))
    content = F.when(
        F.length("unit") > CONTENT_CHARS, F.concat(F.left("unit", F.lit(CONTENT_CHARS)), F.lit("..."))
    ).otherwise(F.col("unit"))
    bad = number_lines(units.where(F.col("v").isNull()).select(content.alias("content"), "uri", "block", "seq"), blocks)
    return bad.select("uri", "line_number", "content", F.lit(INVALID).alias("error"))


def _large(spark, layout, work) -> tuple[DataFrame, list[str], list[str]]:
    """Records of large documents as valid units; the paths of the documents, and of the files that are no single value.

    The rule is that of ``json_documents``: such files count by their lines.
    """
    folder = f"{work}/large-{layout.id}"
    units, none = document_units(spark, layout.paths, folder)
    units.write.mode("overwrite").parquet(f"{folder}/units")
    units = spark.read.parquet(f"{folder}/units")
    checked(units, True).where("v is null").select("uri").distinct().write.mode("overwrite").parquet(f"{folder}/bad")
    bad = spark.read.schema("uri string").parquet(f"{folder}/bad")
    wrong = {r.uri for r in bad.collect()}  # at most the paths of the layout
    lines = [p for p in layout.paths if p in none or scan_uri(p) in wrong]
    found = units.where("part = 'record'").drop("part").join(bad, "uri", "left_anti")
    return found, [p for p in layout.paths if p not in lines], lines


def _units(spark, layout, by_unit, route) -> DataFrame:
    source = json_documents if route == "json-document" else json_lines
    return checked(source(spark, layout.paths), by_unit)


def _sample_records(layout: Layout, as_lines: bool, documents: bool) -> list[dict]:
    """Parsed records in the head of one file; empty when the head shows none for certain."""
    text = layout.sample.lstrip("﻿")
    try:
        if documents:
            return [] if layout.truncated else _document_records(json.loads(text))
        rows = text.splitlines()
        found = []
        for row in filter(None, map(str.strip, rows[:-1] if layout.truncated else rows)):
            try:
                value = json.loads(row)
            except ValueError:
                if not as_lines:
                    return []
                continue
            if as_lines:
                found.append(value if isinstance(value, dict) else {js.VALUE_KEY: value})
            else:
                found += _document_records(value)
        return found
    except (ValueError, RecursionError):
        return []


def _first_records(rows: DataFrame) -> tuple[list[dict], bool]:
    """Parsed records from the beginning of the first file of a table of records, for the guess only, and whether the
    very first is among them. Long ones are left out."""
    least = rows.where("rec is not null").agg(F.min(F.struct("uri", "seq", "item")).alias("first")).first()["first"]
    if least is None:
        return [], False
    some = rows.where((F.col("uri") == least["uri"]) & (F.length("rec") <= FIRST_CHARS)).select("seq", "item", "rec")
    got = some.orderBy("seq", "item").limit(FIRST_RECORDS).collect()
    try:
        found = [json.loads(r["rec"]) for r in got]
    except (ValueError, RecursionError):
        return [], False
    leads = bool(got) and (got[0]["seq"], got[0]["item"]) == (least["seq"], least["item"])
    return (found, leads) if all(isinstance(r, dict) for r in found) else ([], False)


def _document_records(value) -> list[dict]:
    """Records of a small parsed value, for the guess only."""
    if isinstance(value, dict):
        lists = (v for v in value.values() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v))
        return next(lists, [value])
    items = value if isinstance(value, list) else [value]
    return [x if isinstance(x, dict) else {js.VALUE_KEY: x} for x in items]


_SCHEMA_AGG = "schema_of_variant_agg(rv)"


def ingest_json(
    spark: SparkSession, layout: Layout, opts: IngestOptions, out: str, work: str, colliding,
    route: str,
) -> list[Outcome]:
    """Read a JSON layout. The route tells whether whole files, records that many tasks cut out of them, or lines are values."""
    if route != "json-large":
        as_lines = layout.format in LINE_FORMATS
        return _ingest_units(spark, layout, _units(spark, layout, as_lines, route), opts, out, work, colliding, route)
    units, whole, lines = _large(spark, layout, work)
    found = []
    if whole:
        found += _ingest_units(spark, replace(layout, paths=whole), units, opts, out, work, colliding, route)
    if lines:
        rest = replace(layout, id=f"{layout.id}-linhas", paths=lines)
        found += ingest_json(spark, rest, opts, out, work, colliding, "json-lines")
    return found


def _ingest_units(spark, layout: Layout, units: DataFrame, opts, out: str, work: str, colliding, route: str) -> list[Outcome]:
    documents, large = route == "json-document", route == "json-large"
    as_lines = layout.format in LINE_FORMATS
    tolerant = as_lines and opts.continue_on_error
    folder = f"{out}/layout={layout.id}"
    failed = invalid = None

    sample = [] if large else _sample_records(layout, as_lines, documents)
    guess, order, complete = js.guess_shape(sample)
    plan = js.build_columns(guess, order, opts.flatten, opts.preserve_sensitive, opts.extra_sensitive)
    if plan[1] and not opts.per_file_schema:
        rows, watch = observed(
            records(units, as_lines),
            schema=F.expr(_SCHEMA_AGG), bad=F.count_if(F.col("rec").isNull()),
        )
        outcome = _write(rows, plan, layout, opts, folder, colliding)
        seen = watch.get
        same = js.parse_schema(seen["schema"]) == guess
        # Key order is settled when one record already shows every key, else by all records.
        settled = same and complete
        if seen["bad"]:
            if tolerant:
                invalid = quarantine(spark, layout.paths, units)
            else:
                failed = _failed(spark, layout, units, as_lines, work)
        if settled and failed is None:
            outcome.invalid = invalid
            return [outcome]
        if failed is not None:
            units = units.join(failed.select("uri"), "uri", "left_anti")
    elif not large:
        bad = units.where(F.col("v").isNull())
        if not bad.isEmpty():
            if tolerant:
                invalid = quarantine(spark, layout.paths, units)
            else:
                failed = _failed(spark, layout, units, as_lines, work)
                units = units.join(failed.select("uri"), "uri", "left_anti")

    if large:
        rows = units.select(js.wrapped(F.col("unit")).alias("rec"), "uri", "seq", F.lit(0).alias("item"))
        rows = rows.withColumn("rv", js.lenient_variant(F.col("rec")))
    else:
        rows = records(units, as_lines)
    if not as_lines and not large:
        # Records cut out of documents are kept, so that the passes below share the work evenly
        # however large single documents are.
        folder_of_records = f"{work}/records-{layout.id}"
        rows.where("rec is not null").select("rec", "uri", "seq", "item").write.mode("overwrite").parquet(folder_of_records)
        rows = spark.read.parquet(folder_of_records).withColumn("rv", js.lenient_variant(F.col("rec")))
    if opts.per_file_schema:
        return _per_file(spark, rows, layout, opts, folder, work, colliding, failed, invalid)
    if not as_lines:  # the rows come from a table: its first records cost little and suggest what the head did not
        first, leads = _first_records(rows)
        guess, order, complete = js.guess_shape(first)
        plan = js.build_columns(guess, order, opts.flatten, opts.preserve_sensitive, opts.extra_sensitive)
        if plan[1] and leads and complete:
            seen_rows, watch = observed(rows, schema=F.expr(_SCHEMA_AGG))
            outcome = _write(seen_rows, plan, layout, opts, folder, colliding)
            if js.parse_schema(watch.get["schema"]) == guess:
                outcome.failed, outcome.invalid = failed, invalid
                return [outcome]
    schema = js.parse_schema(rows.agg(F.expr(_SCHEMA_AGG)).first()[0])
    plan = js.build_columns(
        schema, js.key_order(rows, schema), opts.flatten, opts.preserve_sensitive, opts.extra_sensitive
    )
    if not plan[1]:
        return [Outcome(layout.id, failed=failed, invalid=invalid)]
    outcome = _write(rows, plan, layout, opts, folder, colliding)
    outcome.failed, outcome.invalid = failed, invalid
    return [outcome]


def _failed(spark, layout, units, as_lines, work) -> DataFrame:
    if as_lines:
        bad = quarantine(spark, layout.paths, units).groupBy("uri").agg(F.min("line_number").alias("n"))
        table = bad.select(
            "uri", F.format_string("Linha %d inválida no JSONL: " + INVALID, F.col("n")).alias("erro")
        )
    else:
        table = units.where(F.col("v").isNull()).select("uri").distinct().withColumn("erro", F.lit(MALFORMED))
    folder = f"{work}/failed-{layout.id}"
    table.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def _per_file(spark, rows, layout, opts, folder, work, colliding, failed, invalid) -> list[Outcome]:
    """Group the files of a layout by their own schema and write each group."""
    schemas = f"{work}/schemas-{layout.id}"
    rows = rows.where("rec is not null")
    rows.groupBy("uri").agg(F.expr(_SCHEMA_AGG).alias("schema")).write.mode("overwrite").parquet(schemas)
    per_file = spark.read.parquet(schemas)
    outcomes = []
    for k, (described,) in enumerate(per_file.select("schema").distinct().collect()):
        schema = js.parse_schema(described)
        mine = rows.join(per_file.where(F.col("schema") == described).select("uri"), "uri", "left_semi")
        plan = js.build_columns(
            schema, js.key_order(mine, schema), opts.flatten, opts.preserve_sensitive, opts.extra_sensitive
        )
        if not plan[1]:
            continue
        outcome = _write(mine, plan, layout, opts, f"{folder}-{k}", colliding)
        outcome.layout = f"{layout.id}-{k}"
        outcomes.append(outcome)
    outcomes = outcomes or [Outcome(layout.id)]
    outcomes[0].failed, outcomes[0].invalid = failed, invalid
    return outcomes


def _write(rows: DataFrame, plan, layout: Layout, opts: IngestOptions, folder: str, colliding) -> Outcome:
    schema, columns = plan
    options = {"allowSingleQuotes": "false"}
    # A metric keeps filters above it: pushed below, they would repeat the parsing they depend on.
    rows, _ = observed(rows.select("rec", "uri"), n=F.count(F.lit(1)))
    parsed = rows.withColumn("r", F.from_json("rec", schema, options))
    values = [
        js.column_value(F.col("rec"), F.col("r"), paths).alias(f"c{i}") for i, (_, paths) in enumerate(columns)
    ]
    original = [name for name, _ in columns]
    df, final = finish_columns(parsed.where("rec is not null").select(*values, "uri"), original, opts)
    labels = write_layout(df, folder, opts, colliding)
    return Outcome(layout.id, folder, original, final, labels)
