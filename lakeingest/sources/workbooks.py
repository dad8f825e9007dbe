"""Excel workbooks: sheets are listed per workbook, then read one sheet per task step.

A sheet holds at most 1 048 576 rows by the file format and is streamed row by row, so a task's
memory is bounded by the workbook's shared strings.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from itertools import accumulate
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeingest.functions import names as nm
from lakeingest.functions.values import id_text
from lakeingest.operators.framing import Outcome, finish_columns, sheet_uri, write_layout
from lakeingest.options import IngestOptions
from lakeingest.session import remove_tree, spread
from lakeingest.sources.remote import open_input

NO_DATA = "a planilha não contém dados válidos"
BATCH_ROWS = 2000
CONCURRENT_LAYOUTS = 8
_CELLS = "cells array<struct<kind:string,value:string>>"
_ARROW_CELLS = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

# Names of the file format's XML vocabulary.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROW, _VALUE, _TEXT = f"{_MAIN}row", f"{_MAIN}v", f"{_MAIN}t"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Numbers of the built-in date formats.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def sheet_entries(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(sheet name, member)`` in workbook order."""
    rels = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels}
    sheets = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
    out = []
    for s in sheets:
        member = target[s.get(_REL_ID)]
        out.append((s.get("name"), member.lstrip("/") if member.startswith("/") else f"xl/{member}"))
    return out


def list_sheets(files: DataFrame) -> DataFrame:
    """Sheets of every workbook: ``(path, uri, sheet_index, sheet, erro)``."""

    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, uri in zip(batch["path"], batch["uri"]):
                try:
                    with open_input(path) as f, zipfile.ZipFile(f) as book:
                        rows += [(path, uri, i, n, None) for i, (n, _) in enumerate(sheet_entries(book))]
                except Exception as e:  # reported per file
                    rows.append((path, uri, -1, None, f"não foi possível abrir a planilha: {e}"))
            yield pd.DataFrame(rows, columns=["path", "uri", "sheet_index", "sheet", "erro"])

    return files.select("path", "uri").mapInPandas(
        sheets, "path string, uri string, sheet_index int, sheet string, erro string"
    )


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, el in ET.iterparse(f):
            if el.tag == f"{_MAIN}si":
                # Phonetic hints are not part of the text.
                parts = [el.find(f"{_MAIN}t")] + [r.find(f"{_MAIN}t") for r in el.findall(f"{_MAIN}r")]
                out.append("".join(p.text or "" for p in parts if p is not None))
                el.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = set()
    for n in root.iter(f"{_MAIN}numFmt"):
        # Literals, colours and escapes are not part of the pattern.
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "")).lower()
        if re.search("[ymdhs]", code) and "general" not in code:
            custom.add(int(n.get("numFmtId")))
    xfs = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in xfs] if xfs is not None else []
    return {i for i, fmt in enumerate(ids) if fmt in _DATE_FORMATS or fmt in custom}


def _column_number(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _sheet_rows(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, list]]:
    """``(row number, [(kind, text), …])`` of the non-empty rows; kinds: s text, n number, b, d date."""
    strings, dates = _shared_strings(book), _date_styles(book)
    epoch = datetime(1899, 12, 30)
    workbook = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
    if workbook is not None and workbook.get("date1904") in ("1", "true"):
        epoch = datetime(1904, 1, 1)
    with book.open(member) as f:
        for row_no, (_, row) in enumerate(
            (e for e in ET.iterparse(f) if e[1].tag == _ROW), start=1
        ):
            cells: dict[int, tuple] = {}
            for at, c in enumerate(row):
                ref = c.get("r")
                col = _column_number(ref) if ref else at
                kind, v = c.get("t", "n"), c.find(_VALUE)
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(_TEXT))
                    cells[col] = ("s", text)
                elif v is None or v.text is None or kind == "e":
                    continue
                elif kind == "s":
                    cells[col] = ("s", strings[int(v.text)])
                elif kind == "b":
                    cells[col] = ("b", "true" if v.text == "1" else "false")
                elif kind in ("str", "d"):
                    cells[col] = ("s", v.text)
                elif int(c.get("s", 0)) in dates:
                    cells[col] = ("d", (epoch + timedelta(days=float(v.text))).isoformat(" ", "milliseconds"))
                else:
                    cells[col] = ("n", v.text)
            number = int(row.get("r") or row_no)
            row.clear()
            if any(text != "" for _, text in cells.values()):
                yield number, [cells.get(i) for i in range(max(cells) + 1)]


def read_sheets(sheets: DataFrame) -> DataFrame:
    """Rows of the listed sheets: ``(path, uri, sheet_index, sheet, row_no, cells, erro)``."""
    schema = f"path string, uri string, sheet_index int, sheet string, row_no int, {_CELLS}, erro string"
    names = ["path", "uri", "sheet_index", "sheet", "row_no", "cells", "erro"]

    def packed(at: tuple, numbers: list, rows: list, error: str | None = None) -> pa.RecordBatch:
        same = [pa.array([v] * len(numbers), t) for v, t in zip(at, (pa.string(), pa.string(), pa.int32(), pa.string()))]
        cells = _packed_cells(rows) if error is None else pa.nulls(len(numbers), _ARROW_CELLS)
        return pa.record_batch([*same, pa.array(numbers, pa.int32()), cells, pa.array([error] * len(numbers), pa.string())], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in zip(*(batch.column(c).to_pylist() for c in names[:4])):
                path, _, index, sheet = at
                numbers, found = [], []
                try:
                    with open_input(path) as f, zipfile.ZipFile(f) as book:
                        member = sheet_entries(book)[index][1]
                        for number, cells in _sheet_rows(book, member):
                            numbers.append(number)
                            found.append(cells)
                            if len(found) == BATCH_ROWS:
                                yield packed(at, numbers, found)
                                numbers, found = [], []
                    error = None
                except Exception as e:  # reported per file
                    error = f"erro ao ler a aba '{sheet}': {e}"
                if found:
                    yield packed(at, numbers, found)
                if error is not None:
                    yield packed(at, [None], [], error)

    return sheets.mapInArrow(rows, schema)


def _packed_cells(rows: list[list]) -> pa.Array:
    """Rows of ``(kind, text)`` or null as lists of structs, built from columns: no object per cell."""
    cells = [c for row in rows for c in row]
    kinds = pa.array([c and c[0] for c in cells], pa.string())
    values = pa.array([c and c[1] for c in cells], pa.string())
    ends = list(accumulate(map(len, rows), initial=0))
    structs = pa.StructArray.from_arrays([kinds, values], names=["kind", "value"], mask=pa.array([c is None for c in cells], pa.bool_()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def sheet_type(kind: Column, value: Column) -> Column:
    """Aggregate: column type of typed cells."""
    n = F.count(value)
    only = lambda k: F.count_if((kind == k) & value.isNotNull()) == n
    number = value.try_cast("double")
    integral = F.bool_and(F.when(kind == "n", (number % 1 == 0) & (F.abs(number) < 9.2e18) & ~value.contains(".")))
    midnight = F.bool_and(F.when(kind == "d", value.endswith("00:00:00.000")))
    return (
        F.when(n == 0, "string")
        .when(only("n"), F.when(integral, "bigint").otherwise("double"))
        .when(only("b"), "boolean")
        .when(only("d"), F.when(midnight, "date").otherwise("timestamp_ntz"))
        .otherwise("string")
    )


def cell_value(kind: Column, value: Column, target: str, as_text: bool) -> Column:
    """Typed cell. Identifier columns become text without a trailing ``.0``."""
    number = value.try_cast("double")
    if target == "bigint":
        c = F.coalesce(value.try_cast("bigint"), number.cast("bigint"))
        return c.cast("string") if as_text else c
    if target == "double":
        return id_text(number) if as_text else number
    if target in ("boolean", "date", "timestamp_ntz"):
        c = value.try_cast(target)
        return c.cast("string") if as_text else c
    return F.when(kind == "n", id_text(number)).otherwise(value)


def ingest_workbooks(
    spark: SparkSession, files: DataFrame, opts: IngestOptions, out: str, work: str, colliding, mark: str = ""
) -> tuple[list[Outcome], DataFrame]:
    """Read all workbooks; sheets with equal headers are written together, to layouts whose ids end in ``mark``.

    Returns the outcomes and the processed sheets ``(uri, sheet_index, sheet, dataset, header)``.
    """
    listed = list_sheets(spread(files, "path"))
    wanted = listed if opts.all_sheets else listed.where("sheet_index <= 0")
    wanted.write.mode("overwrite").parquet(f"{work}/sheets")
    wanted = spark.read.parquet(f"{work}/sheets")
    good = spread(wanted.where("erro is null").drop("erro"), "path", "sheet_index")
    read_sheets(good).write.mode("overwrite").parquet(f"{work}/cells")
    cells = spark.read.parquet(f"{work}/cells")

    key = ["uri", "sheet_index"]
    heads = cells.where("row_no is not null").groupBy(*key).agg(
        F.min_by("cells", "row_no").alias("head"), F.min("row_no").alias("head_row"),
        F.count(F.lit(1)).alias("n_rows"), F.first("sheet").alias("sheet"), F.max(F.size("cells")).alias("width"),
    )
    # A sheet with a header and no rows counts as empty.
    # Rows may be wider than the header row: columns behind it have an empty header, like gaps in it.
    named = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("head", i)["value"], F.lit("")))
    heads = heads.where("n_rows > 1").withColumn("header", named)
    errors = wanted.where("erro is not null").select("uri", "erro").unionByName(
        cells.where("erro is not null").select("uri", "erro")
    )
    errors = errors.groupBy("uri").agg(F.min("erro").alias("erro"))
    per_file = heads.groupBy("uri").agg(F.count(F.lit(1)).alias("n_sheets"))
    empty = files.select("uri").join(per_file, "uri", "left_anti").join(errors, "uri", "left_anti").select(
        "uri", F.lit(NO_DATA).alias("erro")
    )
    failed_folder = f"{work}/failed-xlsx"
    errors.unionByName(empty).write.mode("overwrite").parquet(failed_folder)
    failed = spark.read.parquet(failed_folder)

    sheets_folder = f"{work}/kept-sheets"
    tagged = (
        heads.join(failed.select("uri"), "uri", "left_anti")
        .join(per_file, "uri")
        .withColumn(
            "dataset",
            F.when(F.col("n_sheets") > 1, nm.normalize_name_col(F.col("sheet"))).otherwise(""),
        )
    )
    # Two sheet names may share a path form; the later one in workbook order is numbered.
    tagged = nm.dedupe_table(tagged, ["uri"], "sheet_index", "dataset", "dataset")
    tagged.select(
        *key, "sheet", "dataset", "header", "head_row",
        F.concat(F.substr(F.sha2(F.array_join("header", "\u001f"), 256), F.lit(1), F.lit(12)), F.lit(mark)).alias("layout"),
    ).write.mode("overwrite").parquet(sheets_folder)
    kept = spark.read.parquet(sheets_folder)

    outcomes = []
    # Rows by layout in one pass, so that a layout's types and write read its own rows only.
    by_layout = f"{work}/cells-by-layout"
    body = cells.where("row_no is not null").join(kept.select(*key, "head_row", "dataset", "layout"), key).where("row_no > head_row")
    body.select("layout", "uri", "dataset", "cells").write.mode("overwrite").partitionBy("layout").parquet(by_layout)
    schema = f"uri string, dataset string, {_CELLS}"
    headers = kept.groupBy("layout").agg(F.first("header")).collect()

    def write(layout: str, header: list[str]) -> Outcome:
        try:
            return _write(spark.read.schema(schema).parquet(f"{by_layout}/layout={layout}"), layout, header, opts, out, colliding)
        except Exception as e:  # fails the books with this header, and no others
            remove_tree(spark, f"{out}/layout={layout}")
            message = str(e).split("\n\nJVM stacktrace")[0].strip()
            bad = kept.where(F.col("layout") == layout).select("uri", F.lit(message).alias("erro")).distinct()
            return Outcome(layout, failed=bad, sheets=True)

    with ThreadPoolExecutor(CONCURRENT_LAYOUTS) as pool:
        outcomes += pool.map(lambda row: write(*row), headers)
    outcomes.append(Outcome("xlsx", failed=failed))
    return outcomes, kept


def _write(rows: DataFrame, layout: str, header: list[str], opts, out: str, colliding) -> Outcome:
    original = nm.repeated_header_names(header)
    at = lambda i: F.get("cells", F.lit(i))
    row = rows.agg(*[
        sheet_type(at(i)["kind"], at(i)["value"]).alias(f"c{i}") for i in range(len(original))
    ]).first()
    values = []
    for i, name in enumerate(original):
        as_text = opts.preserve_sensitive and nm.is_sensitive(name, opts.extra_sensitive)
        values.append(cell_value(at(i)["kind"], at(i)["value"], row[i], as_text).alias(f"c{i}"))
    # The sheet's dataset name travels behind the file, so that one write serves all sheets.
    uri = sheet_uri(F.col("uri"), F.col("dataset"))
    df, final = finish_columns(rows.select(*values, uri.alias("uri")), original, opts)
    folder = f"{out}/layout={layout}"
    labels = write_layout(df, folder, opts, colliding)
    return Outcome(layout, folder, original, final, labels, sheets=True)
