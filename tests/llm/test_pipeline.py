import random

import pytest

import corpus_pipeline as pipeline
from lakeingest.llm import queries
from tests.conftest import SF_DIR
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted junk, copies, passages and leaks; returns the folder and what should stay."""
    rng = random.Random(8)
    folder = str(tmp_path_factory.mktemp("tables"))
    clean = {i: "\n".join(prose(rng, 30) for _ in range(6)) for i in range(200)}
    item = prose(rng, 40)
    passage = "\n".join(prose(rng, 20) for _ in range(4))
    rows = dict(clean)
    rows |= {1000 + i: " ".join(w.upper() + "!!" for w in prose(rng, 90).split()) for i in range(30)}
    rows |= {2000 + i: clean[i] for i in range(5)}
    rows |= {3000 + i: clean[10 + i].replace("\n", " ") + "\n" + prose(rng, 1) for i in range(5)}
    rows |= {4000 + i: prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60) for i in range(4)}
    rows |= {5000: prose(rng, 50) + " " + item + " " + prose(rng, 50)}
    docs = [(i, t, "en", "s", len(t)) for i, t in rows.items()] + [(6000, None, "en", "s", None), (6001, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 1000), 0) for i in rows if i < 2000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage


def test_stages(spark, tables):
    folder, rows, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs, _ = pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {name: set(kept) for name, kept in seen.items()}
    assert not any(1000 <= i < 2000 or i >= 6000 for i in ids["quality_rules"]) and len(ids["quality_rules"] & set(range(200))) >= 198
    assert not any(2000 <= i < 3000 for i in ids["line_dedup"])
    assert passage in seen["line_dedup"][4000] and not any(passage.split("\n")[1] in seen["line_dedup"][i] for i in (4001, 4002, 4003))
    near = ids["line_dedup"] - ids["near_dedup"]
    assert near <= {i for i in rows if i >= 3000} and len(near) >= 4
    assert ids["near_dedup"] - ids["decontamination"] == {5000}
    packed = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == ids["decontamination"]
    whole = {}
    for r in packed:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in packed)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_on_the_given_tables(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
