import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeingest import IngestOptions, ingest
from lakeingest.catalog.workbooks import workbook_bytes
from lakeingest.operators import framing
from lakeingest.plans import ingest as plan
from lakeingest.plans.audit import write_reports
from lakeingest.session import BATCH_BYTES, LISTING, isolated, small_batches
from lakeingest.sources import bigjson, records
from tests.conftest import rows


def run(spark, drop, **options):
    return ingest(spark, [drop.root], drop.out, IngestOptions(continue_on_error=True, hash_sources=False, **options))


def test_cells_behind_the_header(spark, drop):
    drop("a.xlsx", workbook_bytes({"S": [["a"], [1, 2, "fica"]]}))
    df = run(spark, drop).table()
    assert rows(df) == [(1, 2, "fica")] and df.columns[0] == "a"


def test_books_of_one_name_with_equal_sheets(spark, drop):
    for k, folder in enumerate(("x", "y")):
        drop(f"{folder}/a.xlsx", workbook_bytes({"S": [["v"], [k]], "T": [["v"], [k + 10]]}))
    drop("a__s.csv", "v\n7\n8\n")
    result = run(spark, drop, all_sheets=True)
    assert {(r.caminho_original.rsplit("/in/", 1)[1], r.linhas_lidas) for r in result.audit.collect()} == {("x/a.xlsx", 2), ("y/a.xlsx", 2), ("a__s.csv", 2)}
    assert all(len(set(r.caminho_parquet_gerado)) in (1, 2) for r in result.audit.collect())
    assert sorted(r[0] for r in result.table().collect()) == [0, 1, 7, 8, 10, 11]


def test_names_shared_by_many_sources(spark, drop, monkeypatch):
    for k in range(4):
        drop(f"d{k}/same.csv", f"v\n{k}\n")
        drop(f"d{k}/other.csv", f"v\n{k}\n")
    drop("alone.csv", "v\n9\n")
    few = {r.caminho_parquet_gerado[0].rsplit("/", 1)[1] for r in run(spark, drop).audit.collect()}
    monkeypatch.setattr(framing, "MAX_LISTED_COLLISIONS", 1)
    many = {r.caminho_parquet_gerado[0].rsplit("/", 1)[1] for r in run(spark, drop).audit.collect()}
    assert few == many and len(few) == 9 and "lake_source=alone.parquet" in few


def test_a_column_named_like_the_partition(spark, drop):
    drop("a.csv", "lake_source,k\nx,1\n")
    drop("b.csv", "k,v\n2,y\n")
    result = run(spark, drop)
    assert {r.status for r in result.audit.collect()} == {"sucesso"}
    assert rows(result.table().select("k", "lake_source", "v"), "k") == [(1, "x", None), (2, None, "y")]


def test_layouts_with_other_types(spark, drop):
    drop("a.csv", "k,v\n1,2\n")
    drop("b.csv", "v,k\nx,3\n")
    drop("c.jsonl", '{"k":4,"v":{"w":1}}\n')
    drop("d.csv", "k\n0.5\n")
    assert rows(run(spark, drop).table().select("k", "v"), "k") == [(0.5, None), (1.0, "2"), (3.0, "x"), (4.0, '{"w":1}')]


@pytest.mark.parametrize("doc", (
    '[1.5, NaN, {"a":[{"b":1}]}, "x", null]', '{"z":[1],"i":[{"id":1},{"id":2,"t":"é]"}],"j":[{"n":1}]}', '{"a":[],"b":[{"x":1},2]}',
    "[]", "{}", " 7 ", '"s"', '{"k":{"i":[{"a":1}]}}'))
def test_large_documents_are_cut_like_small_ones(spark, drop, monkeypatch, doc):
    drop("d.json", doc)
    small = run(spark, drop)
    want = rows(small.table()) if small.folders else []
    monkeypatch.setattr(plan, "MAX_DOCUMENT_BYTES", 0)
    large = run(spark, drop)
    got = rows(large.table()) if large.folders else []
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert [r.status for r in large.audit.collect()] == [r.status for r in small.audit.collect()]


def test_malformed_documents(spark, drop, monkeypatch):
    monkeypatch.setattr(plan, "MAX_DOCUMENT_BYTES", 0)
    docs = "[1,2", "[1 2]", '{"a":1', '{"a" 1}', "{1:2}", "[1] x", '{"a":[{"b":1},]}', "[,]", '{"a":[{"b":1}}', '["a]'
    for i, doc in enumerate(docs):
        drop(f"d{i}.json", doc)
    assert [r.status for r in run(spark, drop).audit.collect()] == ["erro"] * len(docs)


def test_lines_behind_a_long_first_line(spark, drop):
    """A first line longer than the head: the file is no single value on either side of the limit."""
    drop("d.json", json.dumps({"k": 1, "t": "x" * 150_000}) + '\n{"k": 2}\n')
    for limit in (None, 1000):
        options = IngestOptions(document_bytes=limit, continue_on_error=True)
        result = ingest(spark, [drop.root], f"{drop.out}-{limit}", options)
        assert [r.status for r in result.audit.collect()] == ["sucesso"]
        assert rows(result.table().select("k"), "k") == [(1,), (2,)]


def random_document(rng):
    value = lambda depth: rng.choice((
        lambda: rng.choice((1, -2.5, None, True, "", "a\\", '"', "[{,}]", "é😀", "\n")),
        lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))] if depth else 0,
        lambda: {rng.choice('ab"\\'): value(depth - 1) for _ in range(rng.randint(0, 3))} if depth else "x"))()
    objects = lambda: [{"k": value(2)} for _ in range(rng.randint(0, 5))]
    doc = rng.choice((lambda: value(4), objects, lambda: {"n": value(2), "l": objects(), "m": value(3), "o": objects()}))()
    return json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1)))


def expected_records(doc):
    value = json.loads(doc)
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        return next((v for v in value.values() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)), [value])
    return [value]


@pytest.mark.parametrize("size", (3, 17, 64))
def test_ranges_of_any_size_give_the_same_records(spark, tmp_path, size):
    rng, docs, paths = random.Random(size), [], []
    for i in range(60):
        docs.append(random_document(rng))
        path = tmp_path / f"d{i}.json"
        path.write_text(("\ufeff" if i % 5 == 0 else "") + " \n" * (i % 4) + docs[-1] + "\n " * (i % 3))
        paths.append(str(path))
    units, none = bigjson.document_units(spark, paths, str(tmp_path / "work"), size)
    got = {}
    for r in units.collect():
        got.setdefault((r.uri.rsplit("/", 1)[1], r.part), []).append((r.block, r.seq, r.unit))
    assert none == []
    for i, doc in enumerate(docs):
        found = [json.loads(u) for *_, u in sorted(got.get((f"d{i}.json", "record"), []))]
        assert found == expected_records(doc), doc
        for *_, around in got.get((f"d{i}.json", "around"), []):
            json.loads(around)


def test_malformed_large_document_fails_alone(spark, drop, monkeypatch):
    monkeypatch.setattr(plan, "MAX_DOCUMENT_BYTES", 0)
    drop("bad.json", '[{"a":1},{"a":2')
    drop("good.json", '[{"a":1},{"a":2}]')
    result = run(spark, drop)
    assert {r.nome_original: r.status for r in result.audit.collect()} == {"bad.json": "erro", "good.json": "sucesso"}
    assert rows(result.table(), "a") == [(1,), (2,)]


def test_long_header(spark, drop):
    names = [f'"n{i}\n' + "x" * 50_000 + '"' for i in range(5)]
    drop("a.csv", "\n \n" + ",".join(names) + "\r\n1,2,a,4,5\r\n6,7,b,9,10\n")
    df = run(spark, drop).table()
    assert [c[:2] for c in df.columns] == ["n0", "n1", "n2", "n3", "n4"]
    assert rows(df.toDF("a", "b", "c", "d", "e"), "a") == [(1, 2, "a", 4, 5), (6, 7, "b", 9, 10)]


def test_report_lists_all_invalid_lines(spark, drop):
    drop("a.jsonl", '{"k":1}\n' + "".join(f"{{bad {i}\n" for i in range(30)))
    drop("b.jsonl", '{"k":2}\n')
    result = run(spark, drop)
    write_reports(result.audit, drop.out + "/r", result.quarantine).collect()
    lines = json.load(open(drop.out + "/r/a_relatorio.json"))["ndjson_linhas_invalidas"]
    assert [(x["line_number"], x["content"]) for x in lines] == [(i + 2, f"{{bad {i}") for i in range(30)]
    assert json.load(open(drop.out + "/r/b_relatorio.json"))["ndjson_linhas_invalidas"] == []


def test_faults_stay_with_their_files(spark, drop):
    drop("good.xlsx", workbook_bytes({"S": [["k"], [1]]}))
    drop("bad.xlsx", b"PK nothing")
    drop("good.csv", "k\n2\n")
    drop("open.csv", 'k\n"3\n')
    result = run(spark, drop)
    assert {r.nome_original: r.status for r in result.audit.collect()} == {
        "good.xlsx": "sucesso", "bad.xlsx": "erro", "good.csv": "sucesso", "open.csv": "erro"}
    assert rows(result.table(), "k") == [(1,), (2,)]


def test_deep_tree_is_listed_whole(spark, tmp_path, monkeypatch):
    """One folder at the top, branches of uneven depth and empty files, whatever the budgets of the rounds."""
    from lakeingest.sources import remote
    from lakeingest.sources.listing import list_files

    want = set()
    for k in range(40):
        folder = tmp_path / "raiz" / "um" / "/".join(f"n{k % (d + 2)}" for d in range(k % 9 + 1)) / f"f{k}"
        folder.mkdir(parents=True)
        for name in ("a.csv", "b [1].json", "vazio.csv"):
            (folder / name).write_text("" if name.startswith("v") else "x")
            want.add((f"file:{folder / name}", 0 if name.startswith("v") else 1))
    for budgets in (remote.WALK_BUDGETS, (1, 2, 3), ()):
        monkeypatch.setattr(remote, "WALK_BUDGETS", budgets)
        got = list_files(spark, [str(tmp_path / "raiz")]).collect()
        assert {(r.path, r.length) for r in got} == want and len(got) == len(want)
    assert list_files(spark, [str(tmp_path / "nichts")]).collect() == []


def test_records_of_a_table_suggest_the_schema(spark, drop, monkeypatch):
    """Where the first records of large documents show every key and type, no pass but the write reads all of them."""
    drop("a.json", json.dumps({"items": [{"z": k, "a": f"t{k}"} for k in range(50)]}))

    def second_pass(*_):
        raise AssertionError("the schema was inferred in a pass of its own")

    with monkeypatch.context() as patch:
        patch.setattr(records.js, "key_order", second_pass)
        df = run(spark, drop, document_bytes=10).table()
    assert df.columns == ["z", "a"] and rows(df, "z") == [(k, f"t{k}") for k in range(50)]


def test_late_keys_and_types_refute_the_first_records(spark, drop):
    late = [{"b": k} for k in range(30)] + [{"a": 1, "b": 0.5}]
    drop("a.json", json.dumps({"items": late}))
    drop("b.json", json.dumps([{"b": 7}, {"c": "x" * 60_000}]))
    df = run(spark, drop, document_bytes=10).table()
    assert sorted(df.columns) == ["a", "b", "c"] and dict(df.dtypes)["b"] == "double"
    assert df.count() == 33 and df.agg({"b": "sum"}).first()[0] == sum(range(30)) + 7.5


def test_rows_go_to_python_in_batches_of_some_bytes(spark):
    """Long rows are handed on by their bytes, not by thousands, and the caller's setting is left as it was."""
    def size(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["n"])

    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 1000).alias("value"))
    largest = lambda df: df.mapInArrow(size, "n bigint").agg(F.max("n")).first()[0]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    with small_batches(spark):
        assert largest(long) < 2 * BATCH_BYTES
    assert spark.conf.get(key, None) == before
    assert int(isolated(spark).conf.get(key)) == BATCH_BYTES


def test_blocks_are_streamed_to_files(spark, tmp_path):
    """The files are those of the joined blocks, and small batches cut no block."""
    from lakeingest.catalog.samples import blocks, write_blocks

    rows = [(i, None if i % 7 == 0 else f"linha {i} " + "é" * (i % 900)) for i in range(5000)] + [(3, "twice"), (9000, None)]
    df = spark.createDataFrame(rows, "k long, value string")
    folder = write_blocks(df, "k", 1000, "b_%04d.txt", str(tmp_path / "b"))
    want = {f"b_{r.bloco:04d}.txt": r.body for r in blocks(df, "k", 1000).collect()}
    assert {p.name: p.read_text() for p in (tmp_path / "b").iterdir()} == want and want["b_0009.txt"] == ""


def test_small_splits_share_tasks(spark, tmp_path):
    """Many small splits are read by few tasks, and lines keep their numbers."""
    from lakeingest.sources.lines import block_table, number_lines, read_lines

    inner = isolated(spark)
    inner.conf.set("spark.sql.files.maxPartitionBytes", "512")
    for k in range(20):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(1, 1001)))
    paths = [str(tmp_path / f"{k}.txt") for k in range(20)]
    lines = read_lines(inner, paths)
    assert lines.select("uri", "block").distinct().count() > 200
    assert lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    got = number_lines(lines, block_table(read_lines(inner, paths))).select("value", "line_number").collect()
    assert len(got) == 20_000 and all(int(r.value.split()[1]) == r.line_number for r in got)


def test_small_files_share_tasks(spark, drop, monkeypatch):
    """Heads are sniffed by several tasks; many small datasets are listed and read by few."""
    for k in range(60):
        drop(f"f{k:02d}.csv", f"a;b\n{k};x\n")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen, sniffed = [], plan.sniff
    monkeypatch.setattr(plan, "sniff", lambda listed: seen.append(listed) or sniffed(listed))
    result = run(spark, drop)
    assert seen[0].select(F.spark_partition_id()).distinct().count() > 4
    spark.conf.set(key, "1024")
    try:
        table = result.table()
        assert table.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(int(r.a) for r in table.collect()) == list(range(60))
    finally:
        spark.conf.set(key, before)
    assert spark.conf.get(LISTING, "10000") == "10000"
