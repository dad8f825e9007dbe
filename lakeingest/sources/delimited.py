"""Delimited text: typed reading of a whole layout in one pass, checked while it is written.

The fast plan assumes three things the head of a file suggests but cannot prove: no record spans
lines, the header text occurs only as the header, and the sampled types hold. Each assumption is a
metric observed during the write. Where one fails, the exact plan takes over: it orders the quote
parity of every split and joins the lines of each record. Both plans read splits in parallel.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeingest.functions import names as nm
from lakeingest.functions.files import decode_single_byte
from lakeingest.functions.values import BOOLEAN, FLOAT, INTEGER, NARROW, matches_type, type_of_column
from lakeingest.operators.framing import Layout, Outcome, finish_columns, observed, write_layout
from lakeingest.options import IngestOptions
from lakeingest.sources.lines import block_table, read_lines

UNCLOSED = "aspas sem fechamento no arquivo"
BAD_UTF8 = "bytes inválidos em UTF-8"
TYPE_MISFIT = "valor incompatível com o tipo inferido na amostra"
#: Rows of the table of splits that a join may send to every task (tens of MB).
SPLITS_SENT = 200_000
#: Whether a piece of text is a record, begins one that its split leaves open, or continues one.
WHOLE, BEGINS, CONTINUES = range(3)


def header_names(layout: Layout) -> list[str]:
    record = next(csv.reader(io.StringIO(layout.header, newline=""), delimiter=layout.sep), [])
    return nm.repeated_header_names(record)


def decoded_lines(spark: SparkSession, layout: Layout) -> DataFrame:
    """``(rec, bad, uri, block, seq)``: text of every line, without line end and byte-order mark."""
    lines = read_lines(spark, layout.paths, "\n")
    if layout.encoding == "utf-8-sig":
        value = F.col("value")
        bad = ~F.is_valid_utf8(value)
        text = F.when((F.col("block") == 0) & value.startswith("﻿"), F.ltrim(value, F.lit("﻿")))
        text = text.otherwise(value)
    else:
        text, bad = decode_single_byte(F.col("value").cast("binary"), layout.encoding), F.lit(False)
    text = F.when(text.endswith("\r"), F.rtrim(text, F.lit("\r"))).otherwise(text)
    return lines.select(text.alias("rec"), bad.alias("bad"), "uri", "block", "seq")


def odd_quotes(rec: Column) -> Column:
    """1 when the text holds an odd number of quotes, else 0."""
    n = F.octet_length(rec) - F.octet_length(F.replace(rec, F.lit('"'), F.lit("")))
    return F.when(rec.contains('"'), n % 2).otherwise(0)


def parse(records: DataFrame, width: int, sep: str) -> DataFrame:
    """Split ``rec`` into text columns ``r.c0…``; extra fields are dropped, missing ones null."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {
        "sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1",
        "maxColumns": str(max(20480, width * 2)),
    }
    return records.withColumn("r", F.from_csv("rec", F.lit(schema), options))


def sample_types(layout: Layout, typed: list[int]) -> dict[int, str]:
    """Types the head of one file suggests: a guess that the write verifies."""
    lines = layout.sample.split("\n")
    lines = lines[:-1] if layout.truncated else lines
    rows = [t for s in lines if (t := s.rstrip("\r")).strip() and t != layout.header]
    records = [r for t in rows for r in csv.reader([t], delimiter=layout.sep)]
    guesses = {}
    for i in typed:
        values = [r[i] for r in records if i < len(r) and r[i] != ""]
        fits = lambda pattern: all(re.search(pattern, v) for v in values)
        if not values:
            guesses[i] = "void"
        elif fits(INTEGER):
            guesses[i] = "bigint"
        else:
            guesses[i] = "double" if fits(FLOAT) else "boolean" if fits(BOOLEAN) else "string"
    return guesses


def doubt(c: Column, guess: str) -> Column:
    """Per value: does it contradict the guessed type?"""
    return F.lit(False) if guess == "string" else c.isNotNull() & (
        F.lit(True) if guess == "void" else ~matches_type(c, guess)
    )


def proof(c: Column, guess: str) -> Column | None:
    """Per value: does it rule out every narrower type? None where no type is narrower."""
    if guess == "string":
        return ~c.rlike(NARROW)
    return ~c.rlike(INTEGER) if guess == "double" else None


def flag_words(flags: dict[int, Column]) -> list[Column]:
    """Flags packed into as few numbers as possible: observing them is then one cheap metric each."""
    words = []
    for start in range(0, len(flags), 60):
        bits = [
            F.when(flag, F.lit(1 << n).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            for n, flag in enumerate(list(flags.values())[start:start + 60])
        ]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return words


def all_set(words: list[int | None], n: int) -> bool:
    """Whether ``n`` packed flags were all seen."""
    return all(
        (word or 0) == (1 << min(60, n - 60 * w)) - 1 for w, word in enumerate(words)
    )


def project(parsed: DataFrame, width: int, types: dict[int, str]) -> DataFrame:
    cols = []
    for i in range(width):
        c, kind = F.col(f"r.c{i}"), types.get(i, "string")
        cols.append((c if kind in ("string", "void") else c.try_cast(kind)).alias(f"c{i}"))
    return parsed.select(*cols, "uri")


def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order as records: ``WHOLE`` ones, and the pieces that lie across the edges of a split.

    ``open_before`` tells whether a split begins inside quotes. Lines that are records pass as they are;
    what is held is one record at most.
    """
    split, parity, held, first, begins, header = None, 0, [], 0, False, None

    def out(uris, numbers, headers, texts, edges) -> pa.RecordBatch:
        kinds = pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()
        return pa.record_batch([pa.array(c, k) for c, k in zip((uris, numbers, headers, texts, edges), kinds)],
                               names=["uri", "line_number", "header_line", "rec", "edge"])

    for batch in batches:
        uris, blocks, numbers, headers, recs, odds, opens = (batch.column(i) for i in range(7))
        if not batch.num_rows:
            continue
        odd, block = odds.to_numpy(zero_copy_only=False), blocks.to_numpy(zero_copy_only=False)
        codes = uris.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(block) != 0)) + 1
        rows: list[tuple] = []
        whole = np.zeros(batch.num_rows, bool)
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            here = uris[low].as_py(), int(block[low])
            if here != split:
                if held:
                    rows.append((split[0], first, header, "\n".join(held), BEGINS if begins else CONTINUES))
                split, parity, held, begins = here, opens[low].as_py(), [], False
            prior = (parity + np.cumsum(odd[low:high]) - odd[low:high]) % 2
            whole[low:high] = (prior == 0) & (odd[low:high] == 0)
            for i in (np.flatnonzero(~whole[low:high]) + low).tolist():
                if prior[i - low] == 0:
                    begins = True
                if not held:
                    first, header = numbers[i].as_py(), headers[i].as_py()
                held.append(recs[i].as_py())
                if prior[i - low] and odd[i]:
                    rows.append((split[0], first, header, "\n".join(held), WHOLE if begins else CONTINUES))
                    held, begins = [], False
            parity = int(prior[-1] + odd[high - 1]) % 2
        passed = pa.array(whole)
        if whole.any():
            edge = pa.array(np.full(int(whole.sum()), WHOLE, np.int32))
            kept = [c.filter(passed) for c in (uris, numbers, headers, recs)]
            yield pa.record_batch([*kept, edge], names=["uri", "line_number", "header_line", "rec", "edge"])
        if rows:
            yield out(*zip(*rows))
    if held:
        yield out([split[0]], [first], [header], ["\n".join(held)], [BEGINS if begins else CONTINUES])


def exact_records(spark: SparkSession, layout: Layout, work: str):
    """Records of files whose quoted fields may span lines: ``(rec, uri, line_number)``, and the
    failed files.

    Quote parity is summed per split and carried over the splits in file order, which tells for
    every line whether it begins inside quotes. A second scan joins lines to records within each split
    and writes the records once to the shared work folder; only the pieces that a split leaves open at
    its edges, two at most, are then grouped, by record. No line is shuffled.
    """
    lines = decoded_lines(spark, layout).withColumn("odd", odd_quotes(F.col("rec")))
    of_file = Window.partitionBy("uri")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first_text = F.min(F.when(F.col("rec").rlike(r"\S"), F.col("seq"))).alias("first_text")
    blocks = block_table(
        lines, (F.sum("odd") % 2).alias("odd_block"), F.bool_or("bad").alias("bad_block"), first_text
    )
    # Facts of a file are settled among its splits, so that no line has to be joined by file.
    blocks.select(
        "uri", "block", "first_seq", "before",
        (F.coalesce(F.sum("odd_block").over(before), F.lit(0)) % 2).alias("open_before"),
        (F.sum("odd_block").over(of_file) % 2 == 1).alias("unclosed"),
        F.bool_or("bad_block").over(of_file).alias("bad_file"),
        F.min(F.col("before") + F.col("first_text") - F.col("first_seq") + 1).over(of_file).alias("header_line"),
    ).write.mode("overwrite").parquet(f"{work}/splits-{layout.id}")
    blocks = spark.read.parquet(f"{work}/splits-{layout.id}")
    failed = blocks.where("unclosed or bad_file").groupBy("uri").agg(
        F.when(F.bool_or("unclosed"), UNCLOSED).otherwise(BAD_UTF8).alias("erro")
    )

    number = F.when(
        F.col("before").isNotNull(), F.col("before") + F.col("seq") - F.col("first_seq") + 1
    ).otherwise(F.raise_error(F.lit("source splits changed between scans")).cast("bigint"))
    # A map-side join keeps the lines in file order; with more splits than it may send out they are sorted again.
    if blocks.count() <= SPLITS_SENT:
        placed = lines.join(F.broadcast(blocks), ["uri", "block"], "left")
    else:
        placed = lines.join(blocks, ["uri", "block"], "left").sortWithinPartitions("uri", "block", "seq")
    folder = f"{work}/lines-{layout.id}"
    (
        placed.where("not (unclosed or bad_file)")
        .select("uri", "block", number.alias("line_number"), "header_line", "rec",
                F.col("odd").cast("int").alias("odd"), F.col("open_before").cast("int").alias("open_before"))
        .mapInArrow(join_lines, "uri string, line_number bigint, header_line bigint, rec string, edge int")
        .write.mode("overwrite").parquet(folder)
    )
    records = spark.read.parquet(folder)

    # At most two pieces per split stay open: what its first lines continue, and what its last line leaves open.
    pieces = records.where(F.col("edge") != WHOLE)
    so_far = of_file.orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(F.col("edge") == BEGINS, F.col("line_number"))
    joined = pieces.withColumn("record", F.last(begun, ignorenulls=True).over(so_far)).groupBy(
        "uri", F.col("record").alias("line_number")
    ).agg(
        F.first("header_line").alias("header_line"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_number", "rec"))), lambda p: p.rec), "\n"
        ).alias("rec"),
    )
    single = records.where(F.col("edge") == WHOLE).drop("edge")
    records = (
        single.unionByName(joined)
        .where(F.col("rec").rlike(r"\S") & (F.col("line_number") != F.col("header_line")))
        .select("rec", "uri", "line_number", (F.col("line_number") - F.col("header_line")).alias("row_position"))
    )
    return records, failed


def ingest_delimited(
    spark: SparkSession, layout: Layout, opts: IngestOptions, out: str, work: str, colliding
) -> list[Outcome]:
    original = header_names(layout)
    if not original:
        raise ValueError("o arquivo CSV não tem cabeçalho")
    width = len(original)
    typed = [
        i for i, name in enumerate(original)
        if not (opts.preserve_sensitive and nm.is_sensitive(name, opts.extra_sensitive))
    ]
    folder = f"{out}/layout={layout.id}"

    # An open quote at the end of a sampled line already shows that records span lines.
    spans = any(line.count('"') % 2 for line in layout.sample.split("\n"))
    if not (opts.per_file_schema or opts.strict_sample or spans):
        types = sample_types(layout, typed)
        parsed = parse(decoded_lines(spark, layout).where(F.col("rec").rlike(r"\S")), width, layout.sep)
        is_header = F.col("rec") == layout.header
        doubts = flag_words({i: ~is_header & doubt(F.col(f"r.c{i}"), types[i]) for i in typed})
        proven = {i: p for i in typed if (p := proof(F.col(f"r.c{i}"), types[i])) is not None}
        proofs = flag_words({i: ~is_header & p for i, p in proven.items()})
        words = {f"doubt{n}": w for n, w in enumerate(doubts)} | {f"proof{n}": w for n, w in enumerate(proofs)}
        parsed = parsed.select(
            "rec", "r", "uri", "bad", odd_quotes(F.col("rec")).alias("odd"),
            is_header.cast("int").alias("header"), *[w.alias(k) for k, w in words.items()],
        )
        parsed, watch = observed(
            parsed, spans=F.max("odd"), bad=F.bool_or("bad"), headers=F.sum("header"),
            **{k: F.bit_or(k) for k in words},
        )
        parsed = parsed.where("header = 0")
        df, final = finish_columns(project(parsed, width, types), original, opts)
        labels = write_layout(df, folder, opts, colliding)
        seen = watch.get
        trusted = not seen["spans"] and not seen["bad"] and seen["headers"] == len(layout.paths)
        fits = not any(seen[f"doubt{n}"] for n in range(len(doubts)))
        fits = fits and all_set([seen[f"proof{n}"] for n in range(len(proofs))], len(proven))
        if trusted and fits:
            return [Outcome(layout.id, folder, original, final, labels)]
        if trusted:  # only the types were misjudged: settle them, then write again
            records = decoded_lines(spark, layout).where(F.col("rec").rlike(r"\S") & ~is_header)
            return [_write(records, None, layout, original, typed, opts, folder, colliding)]

    records, failed = exact_records(spark, layout, work)
    if not opts.per_file_schema and not opts.strict_sample:
        return [_write(records, failed, layout, original, typed, opts, folder, colliding)]

    # Types per file: one aggregate, then one write per distinct list of types.
    parsed = parse(records, width, layout.sep)
    sampled = F.lit(True) if not opts.strict_sample else F.col("row_position") <= opts.strict_sample
    facts = parsed.groupBy("uri").agg(*[
        type_of_column(F.when(sampled, F.col(f"r.c{i}"))).alias(f"c{i}") for i in typed
    ], F.count(F.lit(1)).alias("n_rows"))
    facts_folder = f"{work}/types-{layout.id}"
    facts.write.mode("overwrite").parquet(facts_folder)
    facts = spark.read.parquet(facts_folder)
    outcomes = []
    keys = [f"c{i}" for i in typed]
    vectors = facts.select(*keys).distinct().collect() if keys else [None]
    for k, vector in enumerate(vectors):
        types = dict(zip(typed, vector)) if vector is not None else {}
        same = facts
        for key, kind in zip(keys, vector or ()):
            same = same.where(F.col(key) == kind)
        mine = parsed.join(same.select("uri"), "uri", "left_semi")
        wrong = failed if k == 0 else None
        if opts.strict_sample:
            misfit = reduce(
                lambda a, b: a | b, [doubt(F.col(f"r.c{i}"), t) for i, t in types.items() if t != "void"],
                F.lit(False),
            )
            bad = mine.where(misfit).select("uri").distinct().withColumn("erro", F.lit(TYPE_MISFIT))
            mine = mine.join(bad, "uri", "left_anti")
            wrong = bad if wrong is None else wrong.unionByName(bad)
        df, final = finish_columns(project(mine, width, types), original, opts)
        where = f"{folder}-{k}"
        labels = write_layout(df, where, opts, colliding)
        outcomes.append(Outcome(f"{layout.id}-{k}", where, original, final, labels, wrong))
    return outcomes or [Outcome(layout.id, None, original, failed=failed)]


def _write(records, failed, layout, original, typed, opts, folder, colliding) -> Outcome:
    width = len(original)
    parsed = parse(records, width, layout.sep)
    types = {}
    if typed:
        row = parsed.agg(*[type_of_column(F.col(f"r.c{i}")).alias(f"c{i}") for i in typed]).first()
        types = {i: row[f"c{i}"] for i in typed}
    df, final = finish_columns(project(parsed, width, types), original, opts)
    labels = write_layout(df, folder, opts, colliding)
    return Outcome(layout.id, folder, original, final, labels, failed)
