import hashlib
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lakeingest import IngestOptions, ingest
from lakeingest.operators.framing import escaped_partition, output_names, write_parquet
from lakeingest.plans import ingest as plans
from lakeingest.plans.audit import AUDIT_FIELDS, report_text, summarize, write_reports
from lakeingest.session import partition_folder


@pytest.fixture
def mixed(spark, drop):
    drop("a.csv", "Nome,e-mail\nx,y\n")
    drop("b.jsonl", '{"k":1}\n' + "{bad\n" * 12)
    drop("c.csv", "")
    drop("d.csv", "q,w\n1,2\n3,4\n")
    drop("e.txt", "ignored")
    return lambda **o: ingest(spark, [drop.root, drop.root + "/a.csv", drop.root + "/none"], drop.out, IngestOptions(**o))


def test_audit_of_a_tolerant_run(mixed, drop):
    result = mixed(continue_on_error=True, normalize=True)
    audit = result.audit
    assert audit.columns == list(AUDIT_FIELDS)
    by = {r.nome_original: r for r in audit.collect()}
    assert {n: r.status for n, r in by.items()} == {
        "a.csv": "sucesso", "b.jsonl": "sucesso_com_alertas", "c.csv": "erro", "d.csv": "sucesso"}
    a = by["a.csv"]
    assert a.hash_sha256 == hashlib.sha256(b"Nome,e-mail\nx,y\n").hexdigest() and a.tamanho_bytes == 16
    assert a.mapa_normalizacao == {"Nome": "nome", "e-mail": "email"}
    b = by["b.jsonl"]
    assert b.ndjson_total_invalidas == 12 and [i.line_number for i in b.ndjson_linhas_invalidas] == list(range(2, 12))
    assert result.quarantine.count() == 12
    assert summarize(audit).first() == (4, 3, 1, 4)

    text = {r[0]: r[1] for r in audit.select("nome_original", report_text(audit)).collect()}
    assert "    - 'Nome' -> 'nome'" in text["a.csv"] and "✅ SUCESSO" in text["a.csv"]
    assert "    - email: String" in text["a.csv"]
    assert text["b.jsonl"].count("    Conteúdo: {bad") == 10 and "e mais linhas inválidas" in text["b.jsonl"]
    assert "ERROS OCORRIDOS" in text["c.csv"] and "vazio" in text["c.csv"]

    paths = [r.path for r in write_reports(audit, drop.out + "/relatorios").collect()]
    assert len(paths) == 8 and all(os.path.exists(p) for p in paths)
    doc = json.load(open(drop.out + "/relatorios/a_relatorio.json"))
    assert doc["status"] == "sucesso" and doc["linhas_lidas"] == 1 and list(doc) == list(AUDIT_FIELDS)


def test_stop_policy(mixed, spark):
    result = mixed()
    audit = result.audit.orderBy("caminho_original").collect()
    assert [(r.nome_original, r.status) for r in audit] == [("a.csv", "sucesso"), ("b.jsonl", "erro")]
    assert result.table().columns == ["Nome", "e-mail"]
    everything = mixed(continue_on_error=True)
    assert everything.table(keep_source=True).select("lake_source").distinct().count() == 3


def test_codecs(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.5), (2, 20.0), (3, 15.25)], "id long, valor double")
    for codec, suffix in (("snappy", ".snappy.parquet"), ("ZSTD", ".zstd.parquet"), ("none", "0.parquet"), ("?", ".snappy.parquet")):
        folder = str(tmp_path / f"c{codec.strip('?')}")
        write_parquet(df, folder, codec)
        assert spark.read.parquet(folder).count() == 3
        assert any(f.endswith(suffix) for f in os.listdir(folder)), os.listdir(folder)


def test_output_names(spark):
    df = spark.createDataFrame([("/a/x.csv",), ("/b/x.json",), ("/b/y.csv",), ("/b/y.csv",)], "path string")
    got = {r.path: (r.dataset, r.kept) for r in output_names(df).collect()}
    assert got["/b/y.csv"] == ("y.parquet", True) and got["/a/x.csv"][0] != got["/b/x.json"][0]
    over = {r.path: (r.dataset, r.kept) for r in output_names(df, "overwrite").collect()}
    assert over["/a/x.csv"] == ("x.parquet", False) and over["/b/x.json"] == ("x.parquet", True)


def test_collision_overwrite_keeps_the_last_path(spark, drop):
    drop("a/x.csv", "k\n1\n")
    drop("b/x.csv", "k\n2\n")
    result = ingest(spark, [drop.root], drop.out, IngestOptions(collision="overwrite"))
    assert [tuple(r) for r in result.table().collect()] == [(2,)]
    assert {r.linhas_lidas for r in result.audit.collect()} == {1}


def datasets(result):
    return {r["lake_source"]: r["k"] for r in result.table(keep_source=True).collect()}


@pytest.mark.parametrize("go_on", (True, False))
def test_overwritten_names_are_plain(spark, drop, go_on):
    for i, name in enumerate(("a/x.csv", "b/x.csv", "c/notas [1].csv", "d/notas [1].csv", "e/y.csv")):
        drop(name, f"k\n{i}\n")
    result = ingest(spark, [drop.root], drop.out, IngestOptions(collision="overwrite", continue_on_error=go_on))
    assert datasets(result) == {"x.parquet": 1, "notas [1].parquet": 3, "y.parquet": 4}
    at = {r.caminho_original.rsplit("/in/")[1]: r.caminho_parquet_gerado for r in result.audit.collect()}
    assert at["a/x.csv"] == at["b/x.csv"] and at["a/x.csv"][0].endswith("lake_source=x.parquet")


def test_an_earlier_file_stays_where_the_last_one_fails(spark, drop):
    drop("a/x.jsonl", '{"k": 1}\n')
    drop("b/x.jsonl", '{"k": 2}\n')
    drop("c/x.json", "{broken")
    drop("d/z.csv", "k\n9\n")
    options = dict(collision="overwrite")
    result = ingest(spark, [drop.root], drop.out, IngestOptions(continue_on_error=True, **options))
    assert datasets(result) == {"x.parquet": 2, "z.parquet": 9}
    assert {r.caminho_original[-8:]: r.status for r in result.audit.collect()}["c/x.json"] == "erro"
    stopped = ingest(spark, [drop.root], drop.out + "-stop", IngestOptions(**options))
    assert datasets(stopped) == {"x.parquet": 2}


def test_no_wave_begins_behind_a_failing_file(spark, drop, monkeypatch):
    begun = []
    convert = plans._convert
    monkeypatch.setattr(plans, "_convert", lambda inner, usable, files, *rest: begun.append(
        [f.path[-6:] for f in files]) or convert(inner, usable, files, *rest))
    for i in range(9):
        drop(f"{i}.json" if i == 5 else f"{i}.csv", "{broken" if i == 5 else f"k\n{i}\n")
    result = ingest(spark, [drop.root], drop.out, IngestOptions(wave_files=2))
    assert begun == [["/0.csv", "/1.csv"], ["/2.csv", "/3.csv"], ["/4.csv", "5.json"]]
    assert datasets(result) == {f"{i}.parquet": i for i in range(5)}
    assert [(r.nome_original, r.status) for r in result.audit.orderBy("nome_original").collect()] == [
        *[(f"{i}.csv", "sucesso") for i in range(5)], ("5.json", "erro")]
    # The same run once more, in one wave and without the broken file, replaces all of it.
    drop("5.json", '[{"k": 5}]')
    again = ingest(spark, [drop.root], drop.out, IngestOptions())
    assert datasets(again) == {f"{i}.parquet": i for i in range(9)} and len(begun) == 4


def test_names_shared_by_files_of_different_waves(spark, drop):
    for i, name in enumerate(("a/x.csv", "b/y.csv", "c/x.csv")):
        drop(name, f"k\n{i}\n")
    result = ingest(spark, [drop.root], drop.out, IngestOptions(wave_files=1, collision="overwrite"))
    assert datasets(result) == {"x.parquet": 2, "y.parquet": 1}


def test_a_given_listing_is_not_looked_up_again(spark, drop, monkeypatch):
    drop("a b%.csv", "k\n1\n")
    drop("c.jsonl", '{"k": 2}\n')
    drop("d.txt", "k")
    listed = [(f"file:{drop.root}/{n}", size, "x") for n, size in (("a b%.csv", 4), ("c.jsonl", 9), ("d.txt", 1), ("c.jsonl", 9))]
    monkeypatch.setattr(plans, "list_sources", None)
    table = spark.createDataFrame([*listed, (None, 3, "x")], "path string, length int, uri string")
    assert datasets(ingest(spark, table, drop.out, IngestOptions(continue_on_error=True))) == {"a b%.parquet": 1, "c.parquet": 2}


def test_no_sources(spark, drop):
    result = ingest(spark, [drop.root], drop.out)
    assert result.audit.count() == 0 and result.quarantine.count() == 0


def test_waves_grow_with_what_lies_before_them():
    files = [SimpleNamespace(path=f"{i:06d}") for i in range(100_000)]
    waves = plans.in_waves(files[::-1], 8)
    assert [f for wave in waves for f in wave] == files and len(waves) < 30
    assert [len(w) for w in waves[:5]] == [8, 8, 8, 12, 18] and plans.in_waves([], 8) == [[]]


def test_partition_folders_are_escaped_as_the_writer_does(spark):
    paths = [f"/a/b%/lake_source={v}.parquet" for v in ("x", "a b=c:d", "q%#\\'\"*?[]{}^", "\x01\x7fé😀+", "tab\t")]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    found = [r[0] for r in table.select(escaped_partition(F.col("path"))).collect()]
    assert found == [partition_folder(spark, p) for p in paths]
