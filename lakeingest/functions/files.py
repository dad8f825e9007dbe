"""Physical properties of a file as Column expressions: format, encoding, delimiter, layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeingest.functions.names import trim_all
from lakeingest.options import SUPPORTED_FORMATS

HEAD_BYTES = 100 * 1024
SAMPLE_LINES = 5
# Fixed order: on equal counts the earlier delimiter is chosen.
DELIMITERS = (",", ";", "\t", "|")

_C1 = "".join(chr(b) for b in range(0x80, 0xA0))
_C1_GLYPHS = "".join(bytes([b]).decode("cp1252", errors="replace") for b in range(0x80, 0xA0))
_UNDEFINED = "".join(c for c, g in zip(_C1, _C1_GLYPHS) if g == "�")
_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


def file_extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"[^/\\]\.([^./\\]+)$", 1)


def detect_format(path: Column) -> Column:
    """The supported format named by the extension, else null."""
    ext = file_extension(path)
    return F.when(ext.isin(*SUPPORTED_FORMATS), ext)


def detect_encoding(head: Column) -> Column:
    """Label of the first encoding that reads the head: utf-8-sig, cp1252 or latin-1.

    A full head may end inside a character, so up to three trailing bytes are forgiven.
    """
    size = F.octet_length(head)
    valid = lambda b: F.is_valid_utf8(b.cast("string"))
    cut = F.lit(False)
    for n in (1, 2, 3):
        cut = cut | valid(F.substr(head, F.lit(1), size - n))
    utf8 = valid(head) | ((size >= HEAD_BYTES) & cut)
    return (
        F.when(utf8, "utf-8-sig")
        .when(~F.decode(head, "ISO-8859-1").rlike(f"[{_UNDEFINED}]"), "cp1252")
        .otherwise("latin-1")
    )


def decode_single_byte(data: Column, encoding: str) -> Column:
    """Text of single-byte data; the 32 C1 codes become the glyphs of code page 1252."""
    text = F.decode(data, "ISO-8859-1")
    return F.translate(text, _C1, _C1_GLYPHS) if encoding == "cp1252" else text


def encode_single_byte(text: Column) -> Column:
    """Inverse of :func:`decode_single_byte` for code page 1252."""
    return F.encode(F.translate(text, _C1_GLYPHS.replace("�", ""), 
                                "".join(c for c in _C1 if c not in _UNDEFINED)), "ISO-8859-1")


def decode_head(head: Column, encoding: Column) -> Column:
    return (
        F.when(encoding == "utf-8-sig", F.ltrim(F.make_valid_utf8(head.cast("string")), F.lit("﻿")))
        .when(encoding == "cp1252", decode_single_byte(head, "cp1252"))
        .otherwise(decode_single_byte(head, "latin-1"))
    )


def sniff_delimiter(text: Column) -> Column:
    """The delimiter counted most often over the first five non-blank lines.

    The per-delimiter counts are taken inside one higher-order function over the delimiters, so
    the text is split once and the lines are not copied per candidate.
    """
    lines = F.filter(F.transform(F.split(text, _LINE_BREAK), trim_all), lambda s: s != "")
    sample = F.array_join(F.slice(lines, 1, SAMPLE_LINES), "\n")
    scored = F.transform(
        F.array(F.struct(sample.alias("s"))),
        lambda b: F.array_max(F.array(*[
            F.struct(
                (F.length(b.s) - F.length(F.replace(b.s, F.lit(d)))).alias("n"),
                F.lit(-i).alias("rank"),
            )
            for i, d in enumerate(DELIMITERS)
        ])),
    )
    return F.element_at(F.array(*map(F.lit, DELIMITERS)), 1 - scored[0].rank)


def header_record(text: Column) -> Column:
    """The first non-blank record of a delimited head; quoted fields may span lines."""
    record = F.regexp_extract(text, r'\A(?:[ \t\r]*+\n)*+((?:[^"\n]++|"[^"]*+")*+)', 1)
    return F.regexp_replace(record, r"\r$", "")


def key_layout(text: Column) -> Column:
    """Sorted keys of the first JSON object, as the layout label of a JSON source."""
    first = F.substring_index(text, "}", 1)
    keys = F.regexp_extract_all(first, F.lit(r'"((?:[^"\\]|\\.)*+)"\s*+:'), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(keys)), "\u001f")


def base_name(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
