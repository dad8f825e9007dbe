import pandas as pd

from lakeingest import IngestOptions, ingest
from lakeingest.catalog.workbooks import workbook_bytes
from lakeingest.sources import workbooks
from tests.conftest import rows

SHEETS = {
    "Clientes": [["nome", "cpf", "cep"], ["Ana", 1234567890, 1001000.0], ["Bia", 5, None]],
    "Vazia": [],
    "Vendas": [["codigo", "valor", "dia", "ok"], ["C001", 10.5, pd.Timestamp("2024-02-29"), True],
               ["C002", 3, pd.Timestamp("2024-03-01"), False]],
}


def run(spark, drop, **options):
    return ingest(spark, [drop.root], drop.out, IngestOptions(continue_on_error=True, hash_sources=False, **options))


def test_first_sheet(spark, drop):
    drop("a.xlsx", workbook_bytes(SHEETS))
    result = run(spark, drop)
    assert rows(result.table(), "nome") == [("Ana", "1234567890", "1001000"), ("Bia", "5", None)]
    row = result.audit.first()
    assert row.xlsx_abas_processadas == ["Clientes"] and row.caminho_parquet_gerado[0].endswith("lake_source=a.parquet")


def test_all_sheets_skip_the_empty_one(spark, drop):
    drop("a.xlsx", workbook_bytes(SHEETS))
    drop("dir/a.xlsx", workbook_bytes({"Só cabeçalho": [["x"]], "Z": [["x"], [1]]}))
    drop("nada.xlsx", workbook_bytes({"Vazia": []}))
    drop("ruim.xlsx", b"not a zip")
    result = run(spark, drop, all_sheets=True)
    by = {r.caminho_original.rsplit("/in/", 1)[1]: r for r in result.audit.collect()}
    assert by["a.xlsx"].xlsx_abas_processadas == ["Clientes", "Vendas"] and by["a.xlsx"].linhas_lidas == 4
    assert by["a.xlsx"].colunas_originais == ["nome", "cpf", "cep"]
    vendas = spark.read.parquet(by["a.xlsx"].caminho_parquet_gerado[1])
    assert dict(vendas.dtypes) == {"codigo": "string", "valor": "double", "dia": "date", "ok": "boolean"}
    assert by["dir/a.xlsx"].xlsx_abas_processadas == ["Z"] and by["dir/a.xlsx"].status == "sucesso"
    assert "dados válidos" in by["nada.xlsx"].erros[0] and "abrir" in by["ruim.xlsx"].erros[0]


def test_equal_sheets_of_different_waves(spark, drop):
    for i, name in enumerate("abc"):
        drop(f"{name}.xlsx", b"not a zip" if name == "c" else workbook_bytes({"S": [["k"], [i]]}))
    drop("d.xlsx", workbook_bytes({"S": [["k"], [9]]}))
    result = ingest(spark, [drop.root], drop.out, IngestOptions(hash_sources=False, wave_files=1))
    assert rows(result.table(keep_source=True), "k") == [(0, "a.parquet"), (1, "b.parquet")]
    assert rows(result.audit.select("nome_original", "status"), "nome_original") == [
        ("a.xlsx", "sucesso"), ("b.xlsx", "sucesso"), ("c.xlsx", "erro")]


def test_cells_are_packed_as_columns():
    """Lists of structs as the objects of single cells give them, with gaps, empty rows and texts of any kind."""
    found = [[("n", "1"), None, ("s", "é")], [], [None], [("b", "true"), ("s", "")]]
    want = [[c and {"kind": c[0], "value": c[1]} for c in row] for row in found]
    assert workbooks._packed_cells(found).to_pylist() == want
    assert workbooks._packed_cells([]).to_pylist() == []
