"""Strict JSON text, record extraction, and the schema, key order and flattening of records."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeingest.functions import names as nm

VALUE_KEY = "valor"
_GUARD = "\\u0001lakeingest"  # no source text carries this control character


# Integers far beyond any number type, which no real text holds, stand for the non-finite words.
_MARKS = {"NaN": "7182818284590452353602874713526624977572470936999595749", "Infinity": "3141592653589793238462643383279502884197169399375105820"}


def _standard(text: Column) -> Column:
    """Non-finite number words, which are accepted as floats, replaced by numbers that stand for them.

    Each match goes on where the last one ended and passes over whole string literals, so words inside
    strings stay.
    """
    marked = text
    for word, mark in _MARKS.items():
        other = rf'[^"{word[0]}]++|"(?:[^"\\]++|\\.)*+"|(?!{word}){word[0]}'
        marked = F.regexp_replace(marked, rf"\G((?:{other})*+)(?<![\w.]){word}(?![\w.])", f"$1{mark}")
    return F.when(text.rlike("NaN|Infinity"), marked).otherwise(text)


def _restored(text: Column) -> Column:
    """The words back in place of the numbers that stand for them."""
    for word, mark in _MARKS.items():
        text = F.replace(text, F.lit(mark), F.lit(word))
    return text


def _guarded(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), _standard(text), F.lit(f',"{_GUARD}"]')))


def _alone(pair: Column) -> Column:
    whole = (F.try_variant_get(pair, "$[1]", "string") == "\x01lakeingest") & (
        F.try_variant_get(pair, "$[2]", "variant").isNull()
    )
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def strict_variant(text: Column) -> Column:
    """VARIANT of exactly one JSON value, else null.

    The JVM parser ignores what follows a value. Inside a two-element array with a guard at the
    end, leftovers either break the array or change its length.
    """
    return _alone(_guarded(text))


def with_strict_variant(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add :func:`strict_variant` in two steps, so that every text is parsed once."""
    return df.withColumn("_pair", _guarded(text)).withColumn(out, _alone(F.col("_pair"))).drop("_pair")


def lenient_variant(text: Column) -> Column:
    """VARIANT of text already known to be one JSON value."""
    return F.try_parse_json(_standard(text))


def is_object(text: Column) -> Column:
    return text.startswith("{")


def wrapped(text: Column) -> Column:
    """Text of the record a value stands for: objects as they are, others under ``valor``."""
    return F.when(is_object(text), text).otherwise(
        F.concat(F.lit(f'{{"{VALUE_KEY}":'), text, F.lit("}"))
    )


def _items(array_text: Column, array_value: Column) -> Column:
    """Record texts of a JSON array: every element keeps its own text, strings are quoted again."""
    texts = F.from_json(array_text, F.lit("array<string>"))
    values = array_value.try_cast("array<variant>")

    def record(t: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        item = F.when(kind == "STRING", F.to_json(v)).otherwise(F.coalesce(t, F.lit("null")))
        return F.when(kind.startswith("OBJECT"), t).otherwise(F.concat(F.lit(f'{{"{VALUE_KEY}":'), item, F.lit("}")))

    return F.zip_with(texts, values, record)


def record_texts(text: Column, value: Column) -> Column:
    """Records of a whole JSON value: list items, the first list of objects in a document, or itself."""
    texts = _record_texts(_standard(text), value)
    return F.when(text.rlike("NaN|Infinity"), F.transform(texts, _restored)).otherwise(texts)


def _record_texts(text: Column, value: Column) -> Column:
    members = F.map_entries(F.from_json(text, F.lit("map<string,string>")))
    values = value.try_cast("map<string,variant>")

    def is_record_list(key: Column) -> Column:
        v = F.element_at(values, key)
        items = v.try_cast("array<variant>")
        return F.schema_of_variant(v).startswith("ARRAY<") & (F.size(items) > 0) & F.forall(
            items, lambda x: F.schema_of_variant(x).startswith("OBJECT")
        )

    lists = F.filter(members, lambda e: e.value.startswith("[") & is_record_list(e.key))
    first = F.from_json(F.get(lists, F.lit(0))["value"], F.lit("array<string>"))
    inside = F.when(F.size(lists) > 0, first).otherwise(F.array(text))
    return (
        F.when(text.startswith("["), _items(text, value))
        .when(~is_object(text), F.array(wrapped(text)))
        .when(~text.contains("["), F.array(text))
        .otherwise(inside)
    )


def parse_schema(described: str | None) -> T.StructType:
    """Stored schema for the type text of ``schema_of_variant_agg``.

    Exact numbers become doubles, and what has no common type, or only nulls, becomes text.
    """
    if not described or not described.startswith("OBJECT<"):
        return T.StructType([])
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], described)
    return _stored(T.DataType.fromDDL(ddl))


def _stored(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _stored(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_stored(t.elementType))
    if isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
        return T.DoubleType()
    if isinstance(t, (T.LongType, T.BooleanType)):
        return t
    return T.StringType()


def guess_shape(values: Sequence[dict]) -> tuple[T.StructType, dict[tuple, tuple], bool]:
    """Schema and key order of a few parsed sample records, and whether the first shows every key."""
    order: dict[tuple, tuple] = {}

    def visit(record: dict, seq: int, prefix: tuple, at: tuple) -> None:
        for i, (key, value) in enumerate(record.items(), start=1):
            order.setdefault((*prefix, key), ("", seq, 0, (*at, i)))
            if isinstance(value, dict):
                visit(value, seq, (*prefix, key), (*at, i))

    for seq, record in enumerate(values):
        visit(record, seq, (), ())
    shape = _shape_of(list(values)) if values else T.StructType([])
    return shape, order, all(first[1] == 0 for first in order.values())


def _shape_of(values: list) -> T.DataType:
    values = [v for v in values if v is not None]
    if values and all(isinstance(v, dict) for v in values):
        keys = sorted({k for v in values for k in v})
        return T.StructType([T.StructField(k, _shape_of([v[k] for v in values if k in v])) for k in keys])
    if values and all(isinstance(v, list) for v in values):
        return T.ArrayType(_shape_of([x for v in values for x in v]))
    if values and all(isinstance(v, bool) for v in values):
        return T.BooleanType()
    if values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        whole = all(isinstance(v, int) and abs(v) < 1 << 63 for v in values)
        return T.LongType() if whole else T.DoubleType()
    return T.StringType()


def leaves(schema: T.StructType, nested: bool, prefix: tuple = ()) -> list[tuple[tuple, T.DataType]]:
    """``(path, type)`` of the output columns; ``nested`` descends into objects."""
    out = []
    for f in schema.fields:
        path = (*prefix, f.name)
        if nested and isinstance(f.dataType, T.StructType):
            out.extend(leaves(f.dataType, True, path))
        else:
            out.append((path, f.dataType))
    return out


def object_paths(schema: T.StructType, prefix: tuple = ()) -> list[tuple]:
    out = [prefix]
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out.extend(object_paths(f.dataType, (*prefix, f.name)))
    return out


def flat_name(path: Sequence[str]) -> str:
    name = path[0]
    for key in path[1:]:
        name = f"{name}_{key}" if name else key
    return name


def _json_path(path: tuple) -> str:
    return "$" + "".join(f"['{k}']" for k in path)


def keys_at(text: Column, path: tuple) -> Column:
    """Keys of the object at ``path`` in document order; null where there is none."""
    if not path:
        return F.json_object_keys(text)
    return F.json_object_keys(F.get_json_object(text, _json_path(path)))


def key_order(records: DataFrame, schema: T.StructType) -> dict[tuple, tuple]:
    """First appearance of every key as a sortable tuple, over all records.

    Records are first reduced to their distinct key lists, combined map-side, so what reaches the
    final aggregate is the variety of shapes and not the number of rows.
    """
    objects = [p for p in object_paths(schema) if not any("'" in k for k in p)]
    every = [p for p, _ in _all_paths(schema) if p[:-1] in objects]
    if not every:
        return {}
    shapes = (
        records.select(F.array(*[keys_at(F.col("rec"), p) for p in objects]).alias("shape"), "uri", "seq", "item")
        .groupBy("shape")
        .agg(F.min(F.struct("uri", "seq", "item")).alias("first"))
    )
    aggregates = []
    for n, path in enumerate(every):
        at = [
            F.array_position(F.col("shape")[objects.index(path[:i])], F.lit(path[i]))
            for i in range(len(path))
        ]
        seen = F.struct("first.uri", "first.seq", "first.item", F.array(*at).alias("at"))
        aggregates.append(F.min(F.when(at[-1] > 0, seen)).alias(f"k{n}"))
    row = shapes.agg(*aggregates).first()
    return {p: (row[n].uri, row[n].seq, row[n]["item"], tuple(row[n]["at"])) for n, p in enumerate(every) if row[n] is not None}


def _all_paths(schema: T.StructType, prefix: tuple = ()):
    for f in schema.fields:
        yield (*prefix, f.name), f.dataType
        if isinstance(f.dataType, T.StructType):
            yield from _all_paths(f.dataType, (*prefix, f.name))


def in_order(schema: T.StructType, order: dict[tuple, tuple], prefix: tuple = ()) -> T.StructType:
    """Fields of every level sorted by first appearance, unknown ones last."""
    last = ("\U0010ffff", 1 << 62, 0, ())
    fields = [
        T.StructField(f.name, in_order(f.dataType, order, (*prefix, f.name)))
        if isinstance(f.dataType, T.StructType) else f
        for f in schema.fields
    ]
    return T.StructType(sorted(fields, key=lambda f: (*order.get((*prefix, f.name), last), f.name)))


def build_columns(schema, order, flatten: bool, preserve: bool, extra) -> tuple[T.StructType, list]:
    """The parse schema and the output columns ``[(name, [paths])]`` in first-seen order.

    Several paths under one flattened name collide; an identifier column is parsed as text, which
    keeps its digits.
    """
    last = ("\U0010ffff", 1 << 62, 0, ())
    found = sorted(leaves(schema, flatten), key=lambda p: (*order.get(p[0], last), p[0]))
    columns: dict[str, list] = {}
    for path, kind in found:
        if flatten and isinstance(kind, T.StructType):
            continue
        columns.setdefault(flat_name(path) if flatten else path[0], []).append((path, kind))
    as_text = set()
    for name, paths in columns.items():
        clash = len({k.simpleString() for _, k in paths}) > 1
        if clash or (preserve and nm.is_sensitive(name, extra)):
            as_text.update(p for p, _ in paths)
    parsed = _retype(in_order(schema, order), as_text, ())
    return parsed, [(name, [p for p, _ in paths]) for name, paths in columns.items()]


def _retype(schema: T.StructType, as_text: set, prefix: tuple) -> T.StructType:
    fields = []
    for f in schema.fields:
        path, kind = (*prefix, f.name), f.dataType
        if path in as_text or (isinstance(kind, T.StructType) and not kind.fields):
            kind = T.StringType()
        elif isinstance(kind, T.StructType):
            kind = _retype(kind, as_text, path)
        fields.append(T.StructField(f.name, kind))
    return T.StructType(fields)


def column_value(rec: Column, parsed: Column, paths: list[tuple]) -> Column:
    """Value of an output column; of colliding paths the last one present in the record counts."""

    def at(path: tuple) -> Column:
        c = parsed
        for key in path:
            c = c.getField(key)
        return c

    value = at(paths[0])
    for path in paths[1:]:
        present = F.coalesce(F.array_contains(keys_at(rec, path[:-1]), F.lit(path[-1])), F.lit(False))
        value = F.when(present, at(path)).otherwise(value)
    return value
