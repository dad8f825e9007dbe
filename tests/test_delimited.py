import csv
import io
import random

from lakeingest import IngestOptions, ingest
from lakeingest.catalog.csvs import LINEITEM_COLUMNS
from lakeingest.operators.framing import Layout
from lakeingest.session import isolated
from lakeingest.sources import delimited, remote
from lakeingest.sources.delimited import exact_records
from tests.conftest import rows

OK = IngestOptions(continue_on_error=True, hash_sources=False)


def run(spark, drop, **options):
    return ingest(spark, [drop.root], drop.out, IngestOptions(continue_on_error=True, hash_sources=False, **options))


def test_identifiers_and_encodings(spark, drop):
    drop("a.csv", "nome,cpf,cep\nInês,000917,00431\nZé,73,5\n")
    drop("b.csv", "nome;cpf;inscrição\nÂngelo;0004;07\nÚrsula;8;61\n".encode("cp1252"))
    result = run(spark, drop)
    audit = {r.nome_original: r for r in result.audit.collect()}
    assert (audit["a.csv"].csv_encoding, audit["a.csv"].csv_separador) == ("utf-8-sig", ",")
    assert (audit["b.csv"].csv_encoding, audit["b.csv"].csv_separador) == ("cp1252", ";")
    assert audit["b.csv"].tipos_inferidos == {"nome": "String", "cpf": "String", "inscrição": "String"}
    a = spark.read.parquet(audit["a.csv"].caminho_parquet_gerado[0])
    assert rows(a, "nome") == [("Inês", "000917", "00431"), ("Zé", "73", "5")]
    b = spark.read.parquet(audit["b.csv"].caminho_parquet_gerado[0])
    assert rows(b, "nome")[0] == ("Ângelo", "0004", "07")


def test_sample_with_normalized_headers(spark, drop):
    drop("s.csv", "nome completo,CPF,CEP,E-MAIL,código\nAna,1,01001,a@x,00012\nBia,2,02002,b@x,00034\n")
    table = run(spark, drop, normalize=True).table()
    assert table.columns == ["nome_completo", "cpf", "cep", "email", "codigo"]
    assert {t for _, t in table.dtypes} == {"string"}


def test_header_text_repeated_as_data_and_two_files(spark, drop):
    drop("x/u.csv", "n,v\n1,2\nn,v\n3,4\n")
    drop("y/u.csv", "n,v\n5,6\n")
    result = run(spark, drop)
    assert rows(result.table(), "n") == [("1", "2"), ("3", "4"), ("5", "6"), ("n", "v")]
    names = {r.caminho_parquet_gerado[0].rsplit("=", 1)[1] for r in result.audit.collect()}
    assert len(names) == 2 and all(n.startswith("u__") for n in names)


def test_bom_blank_lines_and_header_over_two_lines(spark, drop):
    drop("y.csv", b"\xef\xbb\xbf\r\n\r\na,\"b\nq\"\"z\",c\r\n1,2\r\n\r\n3,\"x\"\"y\",4.5,6\r\n")
    table = run(spark, drop).table()
    assert table.columns == ["a", 'b\nq"z', "c"]
    assert rows(table, "a") == [(1, "2", None), (3, 'x"y', 4.5)]


def test_late_misfit_widens_or_fails(spark, drop):
    body = "".join(f"{i},{i}\n" for i in range(30000))
    drop("late.csv", "k,v\n" + body + "1,x\n")
    table = run(spark, drop).table()
    assert dict(table.dtypes) == {"k": "bigint", "v": "string"} and table.count() == 30001
    strict = run(spark, drop, strict_sample=100)
    row = strict.audit.first()
    assert row.status == "erro" and "amostra" in row.erros[0]


def test_narrower_type_than_the_sample_suggests(spark, drop):
    drop("a.csv", "v,w\n1.0,\n" + "2,\n" * 40000 + "3,9\n")
    table = run(spark, drop).table()
    assert dict(table.dtypes) == {"v": "double", "w": "bigint"}


def test_invalid_bytes_behind_the_sample_fail_only_their_file(spark, drop):
    drop("good.csv", "a,b\n1,2\n")
    drop("bad.csv", b"a,b\n" + b"1,2\n" * 60000 + b"1,\xff\n")
    result = run(spark, drop)
    audit = {r.nome_original: r for r in result.audit.collect()}
    assert audit["bad.csv"].status == "erro" and audit["good.csv"].status == "sucesso"
    assert rows(result.table()) == [(1, 2)]


def test_unclosed_quote_fails_only_its_file(spark, drop):
    drop("good.csv", 'a,b\n1,"x\ny"\n')
    drop("bad.csv", 'a,b\n1,"x\n2,y\n')
    result = run(spark, drop)
    assert {r.nome_original: r.status for r in result.audit.collect()} == {"good.csv": "sucesso", "bad.csv": "erro"}
    assert rows(result.table()) == [(1, "x\ny")]


def test_per_file_types_and_header_only_file(spark, drop):
    drop("a.csv", "k,v\n1,2\n")
    drop("b.csv", "k,v\n1,x\n")
    drop("c.csv", "so,cabecalho\n")
    result = run(spark, drop, per_file_schema=True)
    audit = {r.nome_original: r for r in result.audit.collect()}
    assert audit["a.csv"].tipos_inferidos["v"] == "Int64" and audit["b.csv"].tipos_inferidos["v"] == "String"
    assert (audit["c.csv"].status, audit["c.csv"].linhas_lidas) == ("sucesso", 0)


def test_coordinates_only_with_a_preset(spark, drop):
    drop("p.csv", "id_endereco;latitude;lng_coord;nome_rua\nA1;-23,5467;invalido;x\nA2;;-43,2000 ;y\n")
    assert dict(run(spark, drop).table().dtypes)["latitude"] == "string"
    table = run(spark, drop, preset="gis").table()
    assert rows(table, "id_endereco") == [("A1", -23.5467, None, "x"), ("A2", None, -43.2, "y")]


def test_names_that_differ_in_case_only(spark, drop):
    drop("c.csv", "Nome,nome\n1,2\n")
    row = run(spark, drop).audit.first()
    assert row.status == "sucesso" and row.colunas_finais == ["Nome", "nome"]


def test_records_over_many_splits_match_a_sequential_reader(spark, drop):
    """Brute force: random quoting and line breaks, splits far smaller than the records' spread."""
    rng = random.Random(7)
    words = ["a", "bb", 'say "x"', "line\nbreak", "\n\n", "tail\n", ",", "é", "x" * 300]
    expected, folder = [], None
    for n in range(3):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["k", "v", "w"])
        for i in range(400):
            record = [f"{n}-{i}", rng.choice(words), rng.choice(words)]
            expected.append(tuple(record))
            writer.writerow(record)
        folder = drop(f"f{n}.csv", out.getvalue())
    inner = isolated(spark)
    inner.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    result = ingest(inner, [folder], drop.out, OK)
    got = rows(spark.read.parquet(*result.folders).drop("lake_source"))
    assert sorted(got) == sorted(expected)


def test_record_numbers(spark, drop):
    folder = drop("r.csv", 'h\n"a\nb"\n\nc\n"d\n\ne"\n')
    layout = Layout("r", "csv", [f"{folder}/r.csv"], "utf-8-sig", ",", "h")
    records, failed = exact_records(isolated(spark), layout, drop.out)
    assert [(r.line_number, r.rec) for r in records.orderBy("line_number").collect()] == [
        (2, '"a\nb"'), (5, "c"), (6, '"d\n\ne"')]
    assert failed.count() == 0


def test_records_over_many_splits(spark, drop, monkeypatch):
    """Records over split edges, over whole splits and none at all, by both ways of joining the splits."""
    rng, small = random.Random(3), isolated(spark)
    small.conf.set("spark.sql.files.maxPartitionBytes", "512")
    small.conf.set("spark.sql.files.openCostInBytes", "0")
    want = []
    for name in ("a", "b", "c"):
        body = io.StringIO()
        out = csv.writer(body, lineterminator="\n")
        out.writerow(["k", "texto"])
        for i in range(60):
            text = "".join(rng.choice(["x", 'p "q" r', "\n", " y\n", "ç,"]) for _ in range(rng.choice([1, 3, 30, 900 if i % 20 == 7 else 2])))
            text = "z" + text
            out.writerow([f"{name}{i}", text])
            want.append((f"{name}{i}", text))
        folder = drop(f"{name}.csv", body.getvalue())
    for sent in (delimited.SPLITS_SENT, 0):
        monkeypatch.setattr(delimited, "SPLITS_SENT", sent)
        result = ingest(small, [folder], f"{drop.out}/{sent}", IngestOptions())
        assert {r.status for r in result.audit.select("status").collect()} == {"sucesso"}
        assert sorted(tuple(r) for r in result.table().select("k", "texto").collect()) == sorted(want)


def test_header_with_a_stray_quote(spark, drop):
    """A quote that opens in a long header and never closes fails its file; a long quoted header is read whole."""
    long = b'a,"' + b"b" * 300_000 + b'\n",c\n1,2,3\n'
    file = io.BytesIO(long)
    assert long[:102400] + remote._header_rest(file.read(102400), file) == long[:-7]
    stray = b'a,"b' + b"x" * 200_000 + b"\n" + b"1,2\n" * 400_000
    file = io.BytesIO(stray)
    assert remote._header_rest(file.read(102400), file) == b""
    folder = drop("stray.csv", stray)
    got = ingest(spark, [folder], drop.out, IngestOptions(continue_on_error=True)).audit.first()
    assert got.status == "erro" and "aspas sem fechamento" in " ".join(got.erros)


def test_files_of_whole_tables_are_written_by_all_tasks(spark, tmp_path):
    from lakeingest.catalog.csvs import lineitem_files

    spark.range(0, 60, 1, 6).selectExpr(*[f"id AS {c}" for c in LINEITEM_COLUMNS[:-1]], "DATE'2020-01-01' AS l_shipdate").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a partition per file
    try:
        lineitem_files(spark, str(tmp_path), str(tmp_path / "out"), 4)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "out" / "itens").iterdir())) == 6
