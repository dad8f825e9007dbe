"""Value rules: identifier text, coordinates, and the patterns behind column typing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeingest.functions.names import trim_all

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEAN = r"^(?i:true|false)$"
# Union of the three: text outside it can only be text.
NARROW = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:true|false))$"


def plain_double_text(c: Column) -> Column:
    """Shortest decimal text of a double without an exponent, where 38 digits can hold it.

    Spark already prints the shortest digits but switches to ``1.2E7`` outside [1e-3, 1e7);
    those digits are re-read as a decimal, which is exact, and the padding zeros removed.
    """
    text, size = c.cast("string"), F.abs(c)
    wide = text.try_cast("decimal(38,15)").cast("string")
    small = text.try_cast("decimal(38,28)").cast("string")
    unpad = lambda d: F.regexp_replace(F.regexp_replace(d, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (
        F.when((size >= 1e7) & (size < 1e22), unpad(wide))
        .when((size < 1e-3) & (size >= 1e-10), unpad(small))
        .otherwise(text)
    )


def id_text(c: Column) -> Column:
    """Text of a numeric identifier: integral values lose their ``.0``."""
    return F.when((c % 1 == 0) & (F.abs(c) < 9.2e18), c.cast("bigint").cast("string")).otherwise(
        plain_double_text(c)
    )


def coordinate_value(c: Column) -> Column:
    """Coordinate text as double: the first comma is a decimal point, unreadable text is null.

    The pattern guards the cast because Spark would also read ``1.0d``.
    """
    text = F.regexp_replace(trim_all(c), r"^([^,]*),", "$1.")
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def matches_type(c: Column, kind: str) -> Column:
    """Whether non-null text fits a column type."""
    if kind == "bigint":
        return c.rlike(INTEGER) & c.try_cast("bigint").isNotNull()
    if kind == "double":
        return c.rlike(FLOAT)
    if kind == "boolean":
        return c.rlike(BOOLEAN)
    return F.lit(True)


def all_match(c: Column, kind: str) -> Column:
    """Aggregate: do all non-null values fit? Null when every value is null."""
    return F.bool_and(F.when(c.isNotNull(), matches_type(c, kind)))


def type_of_column(c: Column) -> Column:
    """Aggregate: the narrowest type all values fit; text when there is no value at all."""
    return (
        F.when(all_match(c, "bigint"), "bigint")
        .when(all_match(c, "double"), "double")
        .when(all_match(c, "boolean"), "boolean")
        .when(F.count(c) == 0, "void")
        .otherwise("string")
    )
