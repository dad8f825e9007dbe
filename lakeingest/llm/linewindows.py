"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed (128 bits). A window that occurs more than once anywhere
keeps its first occurrence, by (doc_id, hash of the text, position); the lines that later occurrences
cover are merged and removed. Each removed line is therefore kept at an earlier place.

Only hashes and positions are shuffled, pre-aggregated per hash; a frequent window is one row on one side
of the join, so that the skewed side splits freely. Whole texts move once, to meet their positions.

Defined results: null texts stay null, texts of fewer than three lines stay as they are, windows of three
empty lines do not count, a text that loses all lines becomes empty. Rows equal in doc_id and text are one
document: they get the same result. A null doc_id sorts first. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import stored

WINDOW = 3
#: The columns that ``dedup`` adds.
LINES, REMOVED = "lw_lines", "lw_removed"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(id, th, pos, a, b)``: every window of the texts, its place and its two hashes."""
    text = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("th"), _lines(text).alias("lines"))
    hashed = lines.where(F.size("lines") >= window).select(
        "id", "th",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("ha"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("hb"),
    )

    def at(i: Column, name: str) -> Column:
        return F.xxhash64(*[F.get(F.col(name), i + k) for k in range(window)])

    places = F.transform(
        F.sequence(F.lit(0), F.size("ha") - window),
        lambda i: F.struct(i.alias("pos"), at(i, "ha").alias("a"), at(i, "hb").alias("b")),
    )
    empty = F.xxhash64(*[F.xxhash64(F.lit(""))] * window)
    return hashed.select("id", "th", F.explode(places).alias("w")).select("id", "th", "w.*").where(F.col("a") != empty)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(id, th, starts)``: per document the positions of windows that occurred before."""
    all_windows = windows(docs, window)
    place = F.struct("id", "th", "pos")
    twice = all_windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("last > first")
    # As a table of its own, so that Spark may split the rows of a frequent window in the join.
    firsts, _ = stored(twice.select("a", "b", "first"), "first-windows")
    later = all_windows.join(firsts, ["a", "b"]).where(place > F.col("first"))
    return later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with the repeated lines removed, and two columns behind: lines before, and lines removed."""
    # Columns by position while the marks are met, so that no name of theirs can clash.
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows, text = docs.toDF(*at.values()), F.col(at["text"]).cast("string")
    marks = repeats(docs, window).select(F.col("id").alias("m_id"), F.col("th").alias("m_th"), "starts")
    joined = rows.join(marks, F.col(at["doc_id"]).eqNullSafe(F.col("m_id")) & (F.xxhash64(text) == F.col("m_th")), "left")
    lines = _lines(text)
    covered = F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(window)])))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    marked = joined.select(*at.values(), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("starts").isNotNull(), keep).alias("keep"))
    cut = F.array_join(F.transform("keep", lambda i: F.get(lines, i)), "\n")
    changed = F.col("keep").isNotNull()
    values = {"text": F.when(changed, cut).otherwise(F.col(at["text"]))}
    if "n_chars" in at:
        values["n_chars"] = F.when(changed, F.length(cut)).otherwise(F.col(at["n_chars"]))
    return marked.select(
        *[values.get(c, F.col(at[c])).alias(c) for c in docs.columns],
        F.col("n_lines").cast("bigint").alias(LINES),
        F.when(changed, F.col("n_lines") - F.size("keep")).otherwise(0).cast("bigint").alias(REMOVED),
    )


def drop_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs``; documents of which no line is left go."""
    done = dedup(docs, window)
    by_place = done.toDF(*[f"c{i}" for i in range(len(done.columns))])
    lines, removed = (F.col(c) for c in by_place.columns[-2:])
    return by_place.where(~((removed > 0) & (removed == lines))).drop(*by_place.columns[-2:]).toDF(*docs.columns)


SQL = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
places AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS pos FROM lines WHERE len(ls) >= 3),
windows AS (SELECT doc_id, pos, ls[pos] || chr(10) || ls[pos + 1] || chr(10) || ls[pos + 2] AS win FROM places),
later AS (
  SELECT doc_id, pos FROM windows WHERE win <> chr(10) || chr(10)
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS t(k)),
each_line AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM lines),
kept AS (
  SELECT doc_id, string_agg(ls[pos], chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM each_line ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT l.doc_id, coalesce(k.text, '') AS text, len(l.ls) AS n_lines, len(l.ls) - coalesce(k.n, 0) AS n_removed
FROM lines l LEFT JOIN kept k USING (doc_id)
"""
