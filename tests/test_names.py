import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeingest.functions import names as nm
from lakeingest.options import IngestOptions
from lakeingest.sources import remote

NAMES = [
    ("Valor Líquido (R$)", "valor_liquido_r"), ("rua/número", "rua_numero"), ("_ponta__dupla_", "ponta_dupla"),
    ("Fone - e_mail", "fone_email"), ("nome-mail", "nomemail"), ("ÀÉÎÕÜç", "aeiouc"), ("!!!", "coluna"),
    ("a\\b - c", "a_b_c"), ("   ", "coluna"), ("x\u00a0y\x1cz", "x_y_z"), ("2ª via", "2_via"), ("", "coluna_sem_nome"),
]


@pytest.mark.parametrize("name,expected", NAMES)
def test_normalize(name, expected):
    assert nm.normalize_name(name) == expected


def test_normalize_column_form_agrees(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES] + [(None,)], "n string")
    got = [r[0] for r in df.select(nm.normalize_name_col(F.col("n"))).collect()]
    assert got == [e for _, e in NAMES] + ["coluna_sem_nome"]


def test_dedupe_and_mapping():
    final, mapping = nm.normalize_names(["Fim", "fim!", "Início", "Fim", "inicio"])
    assert final == ["fim", "fim_1", "inicio", "fim_2", "inicio_1"]
    assert mapping == {"Fim": "fim_2", "fim!": "fim_1", "Início": "inicio", "inicio": "inicio_1"}
    assert nm.unique_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=12))
def test_normalized_names_are_clean_and_unique(names):
    final, _ = nm.normalize_names(names)
    assert all(re.fullmatch(r"[a-z0-9_]+", f) for f in final)
    assert len(set(final)) == len(final)
    assert [nm.normalize_name(f) for f in final] == final or any("e_mail" in f for f in final)


def test_sensitive_names(spark):
    yes = ["cpf", " CEP ", "Código", "inscrição", "SEÇÃO", "id_municipio_tse", "numero_partido", "titulo_eleitoral"]
    no = ["CPF/CNPJ", "titulo eleitoral", "contato_telefone", "nome", "uf"]
    assert all(nm.is_sensitive(n) for n in yes) and not any(nm.is_sensitive(n) for n in no)
    assert nm.is_sensitive("Matrícula", ["matricula"])
    df = spark.createDataFrame([(n,) for n in yes + no], "n string")
    assert [r[0] for r in df.select(nm.is_sensitive_col(F.col("n"))).collect()] == [True] * 8 + [False] * 5


def test_coordinate_names(spark):
    yes = ["lat", "LON ", "lng_coord", "x_lat", "Latitude", "minha longitude", "lat_1"]
    no = ["flat", "plato", "relatorio", "lonja", "latim"]
    assert all(map(nm.is_coordinate, yes)) and not any(map(nm.is_coordinate, no))
    df = spark.createDataFrame([(n,) for n in yes + no], "n string")
    assert [r[0] for r in df.select(nm.is_coordinate_col(F.col("n"))).collect()] == [True] * 7 + [False] * 5


def test_repeated_headers():
    assert nm.repeated_header_names(["x", "x", "", "x"]) == ["x", "x_duplicada_1", "coluna_sem_nome", "x_duplicada_3"]


def test_presets_lock_options():
    for preset in ("bi", "gis"):
        o = IngestOptions(preset=preset, preserve_sensitive=False).resolve()
        assert o.normalize and o.flatten and o.preserve_sensitive and o.casts_coordinates
    assert not IngestOptions().resolve().normalize
    with pytest.raises(ValueError):
        IngestOptions(preset="x").resolve()


def test_a_folder_is_listed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(remote, "LISTED_ROWS", 3)
    (tmp_path / "d").mkdir()
    for i in range(10):
        (tmp_path / "d" / f"f{i}").write_text("x" * i)
    (tmp_path / "d" / "gone").symlink_to(tmp_path / "nowhere")
    (tmp_path / "d" / "linked").symlink_to(tmp_path / "d" / "f9")
    roots = spark.createDataFrame([(str(tmp_path),)], "path string")
    found = sorted((r.path.rsplit("/", 1)[1], r.length) for r in remote.list_tree(roots).collect())
    assert found == [*((f"f{i}", i) for i in range(10)), ("linked", 9)]
