"""Rules on column names, each as a plain function for headers and as a Column expression.

Headers are metadata and live on the driver; the Column forms apply the same rule to names that
arrive as data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of identifier columns that always stay text, without accents.
SENSITIVE_NAMES = frozenset({
    "cpf", "cnpj", "documento", "titulo_eleitoral", "inscricao", "inscricao_municipal", "cep",
    "telefone", "celular", "zona", "secao", "codigo", "id_municipio", "id_municipio_tse",
    "numero_candidato", "numero_partido",
})

# Coordinate names, applied to an accent-free lower-case name.
COORDINATE_PATTERN = r"^(lat|lon|lng)$|latitude|longitude|^(lat|lon|lng)_|_(lat|lon|lng)$"

UNNAMED = "coluna_sem_nome"
EMPTIED = "coluna"

_BMP = [chr(i) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF]
WHITESPACE = "".join(c for c in _BMP if c.isspace())


def strip_accents(text: str) -> str:
    """Decompose and drop the non-spacing marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


# Every character that loses a mark and is left with one character.
_FOLDS = {c: f for c in _BMP if len(f := strip_accents(c)) == 1 and f != c}
_FOLD_FROM, _FOLD_TO = "".join(_FOLDS), "".join(_FOLDS.values())


def strip_accents_col(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _FOLD_FROM, _FOLD_TO), r"\p{Mn}", "")


# What parts the words of a name, and what a word keeps.
SEPARATORS, WORD = r"[\s\x1c-\x1f\-/\\_]+", "a-z0-9"
_MAIL = re.compile("e[-_]mail")


def trim_all(c: Column) -> Column:
    """Trim every kind of white space; Spark's ``trim`` removes blanks only."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_sensitive(name: str, extra: Iterable[str] = ()) -> bool:
    folded = strip_accents(name.strip().lower())
    return folded in SENSITIVE_NAMES or folded in {strip_accents(e.strip().lower()) for e in extra}


def is_sensitive_col(c: Column) -> Column:
    return strip_accents_col(F.lower(trim_all(c))).isin(sorted(SENSITIVE_NAMES))


def is_coordinate(name: str) -> bool:
    return re.search(COORDINATE_PATTERN, strip_accents(name.lower().strip())) is not None


def is_coordinate_col(c: Column) -> Column:
    return strip_accents_col(F.lower(trim_all(c))).rlike(COORDINATE_PATTERN)


def normalize_name(name: str | None) -> str:
    """Lower-case ASCII name of letters, digits and single inner underscores."""
    if not name:
        return UNNAMED
    words = re.split(SEPARATORS, strip_accents(_MAIL.sub("email", name.lower().strip())))
    return "_".join(filter(None, (re.sub(f"[^{WORD}]", "", w) for w in words))) or EMPTIED


def normalize_name_col(c: Column) -> Column:
    """The same rule: cut at separators, clean each word, join what is left."""
    folded = strip_accents_col(F.regexp_replace(trim_all(F.lower(c)), _MAIL.pattern, "email"))
    words = F.transform(F.split(folded, f"(?U){SEPARATORS}"), lambda w: F.regexp_replace(w, f"[^{WORD}]", ""))
    text = F.array_join(F.filter(words, lambda w: w != ""), "_")
    return F.when(F.coalesce(c, F.lit("")) == "", UNNAMED).when(text == "", EMPTIED).otherwise(text)


def unique_names(names: Sequence[str]) -> list[str]:
    """First use keeps the name, later ones get ``_1``, ``_2``…, passing over taken names."""
    reserved, used, count, out = set(names), set(), {}, []
    for name in names:
        final = name
        if name in used:
            n = count.get(name, 0) + 1
            while (final := f"{name}_{n}") in used or final in reserved:
                n += 1
            count[name] = n
        used.add(final)
        out.append(final)
    return out


def normalize_names(names: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """Normalised unique names, and original → final (a repeated original maps to its last)."""
    final = unique_names([normalize_name(n) for n in names])
    return final, dict(zip(names, final))


def repeated_header_names(names: Sequence[str]) -> list[str]:
    """Header names of a delimited file: a repeat gets ``_duplicada_<position>``."""
    seen, out = set(), []
    for i, name in enumerate(names):
        if name in seen:
            name = f"{name}_duplicada_{i}"
        seen.add(name)
        out.append(name or UNNAMED)
    return unique_names(out)


def dedupe_table(df: DataFrame, keys: Sequence[str], position: str, base: str, out: str) -> DataFrame:
    """The numbering rule on names held as rows: one header per ``keys``, ordered by position.

    The window is keyed by header and name, so it never holds more than one header's repeats.
    """
    w = Window.partitionBy(*keys, base).orderBy(position)
    n = F.row_number().over(w) - 1
    return df.withColumn(out, F.when(n == 0, F.col(base)).otherwise(F.concat_ws("_", base, n)))
