import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeingest.llm import filteraudit as f

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORDS.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * capitals > 5 * len(text), "D": any(c in text for c in "#$%&*|"),
    }


def brute(docs, labels, part):
    rows = [(r["doc_id"], r["text"] or "", r[part] or "") for r in docs]
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    out = {}
    for p in {r[2] for r in rows}:
        mine = [(i, fails(t) | {"E": i is not None and i > smallest[t]}) for i, t, q in rows if q == p]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                lost = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                shapley[x] += len(lost)
                out[p, "".join(order), step] = [
                    len(left), len(lost), sum(d[1][x] for d in mine) - len(lost),
                    sum(d[1][x] and sum(d[1].values()) == 1 for d in mine),
                    sum(d[0] in good for d in lost), sum(d[0] in toxic for d in lost), x]
        for key, value in out.items():
            if key[0] == p:
                value[-1] = shapley[value[-1]] if isinstance(value[-1], str) else value[-1]
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 1, 0), (4, 0, 1), (5, 1, 1), (5, 0, 0), (7, None, 1), (None, 1, 1), (9, 1, 0), (10, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_hard_documents(spark, hard, labels):
    docs = hard.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "y"))
    more = spark.createDataFrame([(100 + i, "A " * 60 if i % 2 else "copy # of a text", "x" if i % 4 else None) for i in range(40)],
                                 "doc_id bigint, text string, source string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    got = f.audit(docs, labels)
    assert dict(got.dtypes)["step"] == "int"
    assert collected(got) == brute(docs.collect(), labels.collect(), "source")


def test_sketch_only_clears_unique_texts():
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    hashes[:900] = hashes[900:1800]
    hashes[-300:] = hashes[0]
    m, total = f.cells_for(len(hashes)), {}
    for part in np.array_split(hashes, 7):
        import pyarrow as pa

        for b in f._partial(iter([pa.record_batch([pa.array(part)], names=["h"])]), m):
            total.setdefault(b.column(0)[0].as_py(), []).append((b.column(1)[0].as_py(), b.column(2)[0].as_py()))
    import pandas as pd

    packed = np.zeros(m // 4, np.uint8)
    for block, parts in total.items():
        merged = f._merged(pd.DataFrame(parts, columns=["cells", "counts"]).assign(block=block))
        packed[block * f.BLOCK // 4 :][: f.BLOCK // 4] = np.frombuffer(merged["packed"][0], np.uint8)
    values, counts = np.unique(hashes, return_counts=True)
    found = f.possible_repeats(values, packed)
    assert found[counts > 1].all()
    assert found[counts == 1].mean() < 0.05


def test_size_of_the_sketch():
    assert f.cells_for(0) == f.cells_for(1) == f.BLOCK
    assert f.cells_for(1 << 20) == 1 << 23
    assert f.cells_for(10**12) == f.MOST_CELLS


def test_a_full_sketch_changes_nothing(spark, hard, labels, monkeypatch):
    docs = hard.withColumn("source", F.lit("one"))
    want = collected(f.audit(docs, labels))
    monkeypatch.setattr(f, "possible_repeats", lambda h, packed: np.ones(len(h), bool))
    assert collected(f.audit(docs, labels)) == want


def test_empty_tables(spark, nothing, hard, labels):
    assert f.audit(nothing, labels).collect() == []
    docs = hard.withColumn("source", F.lit("one"))
    assert collected(f.audit(docs, labels.limit(0))) == brute(docs.collect(), [], "source")
