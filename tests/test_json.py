import json
import random

from pyspark.sql import functions as F

from lakeingest import IngestOptions, ingest
from lakeingest.operators import jsonshape as js
from lakeingest.operators.framing import Layout
from lakeingest.session import isolated
from lakeingest.sources import records
from tests.conftest import rows


def run(spark, drop, **options):
    options = {"continue_on_error": True, "hash_sources": False} | options
    return ingest(spark, [drop.root], drop.out, IngestOptions(**options))


def test_strict_lines_agree_with_a_json_parser(spark):
    lines = ['{"a":1}', '{"a":1} x', '{"a":1}}', '{"a":1},{"b":2}', "[1,2]", "[1,2]]", "7", "7 8", '"q"', '"q', "null", "nul",
             "true", "{}", "[]", "{bad}", "{'a':1}", '{"a":NaN}', "NaN", "-Infinity", '{"a":"NaN, x"}', '{"a":01}', '{"a":1,}',
             '{"a":1,"a":2}', '"\\u00e9"', '"\t"', "1,2", '7,"b":2', '{"a":{"b":[1,{"c":null}]}}', "1e5", ".5", "+1", "{} {}"]

    def valid(s):
        try:
            json.loads(s)
            return True
        except ValueError:
            return False

    from lakeingest.sources.records import checked

    inner = isolated(spark)
    df = inner.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, unit string")
    got = [r.v for r in checked(df, True).select("i", F.col("v").isNotNull().alias("v")).orderBy("i").collect()]
    assert dict(zip(lines, got)) == {s: valid(s) for s in lines}


def test_flatten_three_levels(spark, drop):
    drop("f.json", '{"a":1,"b":{"c":2,"d":{"e":3}},"g":{},"l":[1,2]}')
    table = run(spark, drop, flatten=True).table()
    assert table.columns == ["a", "b_c", "b_d_e", "l"]
    assert table.select("a", "b_c", "b_d_e").first() == (1, 2, 3)


def test_flatten_collision_keeps_the_last_present(spark, drop):
    drop("f.ndjson", '{"a":{"b":1},"a_b":2}\n{"a":{"b":3}}\n{"a":{"b":4},"a_b":null}\n')
    got = rows(run(spark, drop, flatten=True).table())
    assert sorted(got, key=str) == [(2,), (3,), (None,)]


def test_nested_without_flatten(spark, drop):
    drop("n.json", '[{"nome":"x","cpf":"0123","endereco":{"rua":"r","numero":10}}]')
    plain = run(spark, drop).table()
    assert dict(plain.dtypes)["endereco"] == "struct<rua:string,numero:bigint>"
    flat = run(spark, drop, flatten=True).table()
    assert flat.dtypes == [("nome", "string"), ("cpf", "string"), ("endereco_rua", "string"), ("endereco_numero", "bigint")]


def test_record_extraction(spark, drop):
    drop("list.json", '[{"a":1},{"b":2},5,"5",null]')
    drop("single.json", '{"a":1,"b":2}')
    drop("wrapped.json", '{"status":"ok","n":[1],"items":[{"id":1},{"id":2}]}')
    drop("mixed.json", '{"xs":[{"id":1},null],"b":3}')
    drop("scalar.json", "42")
    result = run(spark, drop)
    by = {r.nome_original: r for r in result.audit.collect()}
    read = lambda n: spark.read.parquet(by[n].caminho_parquet_gerado[0])
    assert by["list.json"].linhas_lidas == 5 and read("list.json").columns == ["a", "b", "valor"]
    assert rows(read("single.json")) == [(1, 2)]
    assert rows(read("wrapped.json"), "id") == [(1,), (2,)]
    assert by["mixed.json"].linhas_lidas == 1 and read("mixed.json").columns == ["xs", "b"]
    assert rows(read("scalar.json")) == [(42,)]


def test_lines_in_a_json_file(spark, drop):
    drop("l.json", '[{"z":1},{"z":2}]\n\n{"items":[{"z":3}]}\n')
    drop("bad.json", '{"z":1}\n{"z":\n')
    drop("broken.json", '{"z":')
    result = run(spark, drop)
    by = {r.nome_original: r.status for r in result.audit.collect()}
    assert by == {"l.json": "sucesso", "bad.json": "erro", "broken.json": "erro"}
    assert rows(result.table(), "z") == [(1,), (2,), (3,)]


def test_tolerant_and_strict_lines(spark, drop):
    drop("j.jsonl", '{"id":1,"cpf":12}\n{invalid_json}\n{"id":2,"cpf":1001000.0}\n\n[{"z":9}]\n')
    drop("long.jsonl", '{"id":1}\n' + '{"id":"' + "y" * 200 + "\n")
    result = run(spark, drop)
    by = {r.nome_original: r for r in result.audit.collect()}
    assert by["j.jsonl"].status == "sucesso_com_alertas" and by["j.jsonl"].linhas_lidas == 3
    got = {(r.path.rsplit("/", 1)[1], r.line_number): r.content for r in result.quarantine.collect()}
    assert got[("j.jsonl", 2)] == "{invalid_json}"
    assert got[("long.jsonl", 2)] == '{"id":"' + "y" * 93 + "..."
    table = spark.read.parquet(by["j.jsonl"].caminho_parquet_gerado[0])
    assert dict(table.dtypes) == {"id": "bigint", "cpf": "string", "valor": "array<struct<z:bigint>>"}
    assert {r.cpf for r in table.collect()} == {"12", "1001000.0", None}
    strict = run(spark, drop, continue_on_error=False)
    first = strict.audit.collect()
    assert [r.nome_original for r in first] == ["j.jsonl"] and first[0].erros[0].startswith("Linha 2 inválida")


def test_no_valid_line(spark, drop):
    drop("n.ndjson", "{x}\n{y}\n")
    row = run(spark, drop).audit.first()
    assert row.status == "erro" and "Nenhum registro" in row.erros[0]


def test_key_order_types_and_late_keys(spark, drop):
    lines = [json.dumps({"z": i, "a": {"q": i, "b": 1}}) for i in range(8000)]
    lines += [json.dumps({"new": True, "a": {"c": "x"}, "z": 1.5})]
    drop("o.jsonl", "\n".join(lines))
    table = run(spark, drop, flatten=True).table()
    assert table.dtypes == [("z", "double"), ("a_q", "bigint"), ("a_b", "bigint"), ("new", "boolean"), ("a_c", "string")]
    assert table.count() == 8001


def test_conflicts_bom_and_not_a_number(spark, drop):
    drop("c.ndjson", b'\xef\xbb\xbf{"a":1,"n":NaN}\n{"a":{"b":[1]},"n":2.5}\n{"a":"t\xff","n":null}\n')
    table = run(spark, drop).table()
    assert dict(table.dtypes) == {"a": "string", "n": "double"}
    assert {r.a for r in table.collect()} == {"1", '{"b":[1]}', "t�"}


def test_per_file_schema(spark, drop):
    drop("a.jsonl", '{"k":1}\n')
    drop("b.jsonl", '{"k":"x"}\n')
    result = run(spark, drop, per_file_schema=True)
    assert {r.nome_original: r.tipos_inferidos["k"] for r in result.audit.collect()} == {"a.jsonl": "Int64", "b.jsonl": "String"}


def test_line_numbers_over_many_splits(spark, drop):
    """Brute force: bad and blank lines at random places, three files, tiny splits."""
    rng, expected = random.Random(3), set()
    for n in range(3):
        lines = []
        for i in range(1, 1500):
            kind = rng.random()
            lines.append("" if kind < 0.1 else "{bad" if kind < 0.15 else json.dumps({"i": i, "p": "x" * rng.randint(0, 60)}))
            if lines[-1] == "{bad":
                expected.add((f"f{n}.jsonl", i))
        folder = drop(f"f{n}.jsonl", ("\r\n" if n == 1 else "\n").join(lines))
    inner = isolated(spark)
    inner.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    result = ingest(inner, [folder], drop.out, IngestOptions(continue_on_error=True, hash_sources=False))
    assert {(r.path.rsplit("/", 1)[1], r.line_number) for r in result.quarantine.collect()} == expected


def test_schema_text_with_odd_keys():
    t = js.parse_schema("OBJECT<`a b`: DECIMAL(3,1), c: OBJECT<>, d: ARRAY<VOID>, e: VARIANT>")
    assert t.simpleString() == "struct<a b:double,c:struct<>,d:array<string>,e:string>"


def test_empty_objects_first_and_odd_keys(spark, drop):
    drop("a.ndjson", '{}\n{}\n{"a.b":1,"c`d":{"e f":2},"":3}\n')
    result = run(spark, drop, flatten=True)
    by = {r.nome_original: r for r in result.audit.collect()}
    assert by["a.ndjson"].status == "sucesso" and by["a.ndjson"].linhas_lidas == 3
    assert by["a.ndjson"].colunas_originais == ["a.b", "c`d_e f", ""]
    assert by["a.ndjson"].colunas_finais == ["a.b", "c`d_e f", "coluna_sem_nome"]


def test_large_document_is_read_through_its_records(spark, drop):
    items = [{"id": i, "v": {"w": "x" * 50}} for i in range(3000)] + [{"late": True, "id": 1.5}]
    drop("d.json", json.dumps({"n": [1], "items": items}, indent=1))
    table = run(spark, drop, flatten=True).table()
    assert table.dtypes == [("id", "double"), ("v_w", "string"), ("late", "boolean")] and table.count() == 3001


def test_partitions_without_rows_make_no_file(spark, tmp_path):
    from lakeingest.catalog.samples import write_lines

    df = spark.range(0, 6, 1, 6).where("id % 3 = 1").selectExpr("""concat('{"k":', id, '}') AS value""")
    folder = write_lines(df, str(tmp_path / "in"), "ndjson")
    assert len(list((tmp_path / "in").iterdir())) == 2
    out = ingest(spark, [folder], str(tmp_path / "out"), IngestOptions())  # stops at an empty file
    assert rows(out.table(), "k") == [(1,), (4,)]
    write_lines(df.where("false"), str(tmp_path / "none"), "csv", "k;v")
    assert [f.read_text() for f in (tmp_path / "none").iterdir()] == ["k;v\n"]


def test_invalid_lines_are_shortened_before_the_join(spark, drop):
    drop("a.jsonl", '{"k":1}\n' + "{" + "x" * 5000 + "\n")
    paths = [f"file:{drop.root}/a.jsonl"]
    units = records._units(spark, Layout("l", "jsonl", paths), True, "jsonl")
    found = records.quarantine(spark, paths, units)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unit#" not in plan.split("Join LeftOuter")[1].splitlines()[1].split("AS content")[1]
    assert rows(found.select("line_number", "content")) == [(2, "{" + "x" * 99 + "...")]


def test_files_reach_python_in_small_batches(spark, tmp_path):
    from lakeingest.catalog import samples

    # 400 MB in one partition: a batch of 10 000 rows would hold all of it.
    df = spark.range(0, 400, 1, 1).selectExpr("concat('f', id) AS name", "repeat('x', 1000000) AS content")
    samples.write_files(df, str(tmp_path / "files"))
    assert {f.stat().st_size for f in (tmp_path / "files").iterdir()} == {1000000}
    assert len(list((tmp_path / "files").iterdir())) == 400
