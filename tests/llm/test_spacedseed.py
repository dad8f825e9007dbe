import random

import numpy as np

from lakeingest.llm import spacedseed as s


def brute(docs, items):
    """Pairs that some placement of the item over the text lays over each other well enough."""
    out = set()
    for i, t in docs:
        c = s._codes(s.words(t))
        for j, u in items:
            x = s._codes(s.words(u))
            if any(s.agreeing(c, x, first) for first in range(-len(x), len(c))):
                out.add((i, str(j)))
    return out


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((15, 20, 40, 59, 13, 9, 8, 3))]
    docs = []
    for i in range(120):
        body = [word() for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            item = items[i // 3 % len(items)][1].split()
            if i % 2:
                for at in rng.sample(range(len(item)), len(item) // 6):
                    item[at] = word()
            if i % 5 == 0:
                item = item[: max(len(item) * 2 // 3, 1)]
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((i, ", ".join(body).upper() if i % 4 else " ".join(body)))
    return docs + [(500, items[7][1]), (501, items[7][1] + " more"), (502, None), (503, ""), (504, "!!! ...")], items


def test_against_brute_force(spark):
    docs, items = planted()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "?!")], "item_id int, text string")
    want = brute(docs, items)
    for filter_words in (s.FILTER_WORDS, 64):  # a full filter lets everything pass
        got = {(r["doc_id"], r["item_id"]) for r in s.overlaps(frame, benchmark, filter_words).collect()}
        assert got == want
        clean = {r["doc_id"] for r in s.clean(frame, benchmark, filter_words).collect()}
        assert clean == {i for i, _ in docs} - {i for i, _ in want}
    twice = frame.where("doc_id < 60").unionByName(frame.where("doc_id < 60"))
    got = s.overlaps(twice, benchmark.unionByName(benchmark.where("item_id = 1"))).groupBy("doc_id", "item_id").count().collect()
    assert {(r["doc_id"], r["item_id"]): r["count"] for r in got} == {(i, j): 4 if j == "1" else 2 for i, j in want if i < 60}
    renamed = frame.selectExpr("doc_id", "text", "1 AS met", "2 AS MET_", "3 AS t1", "4 AS firsts")
    assert s.clean(renamed, benchmark).columns == renamed.columns
    assert s.clean(renamed, benchmark).count() == len(docs) - len({i for i, _ in want})
    assert len(want) > 30 and (500, "7") in want and (501, "7") not in want


def test_substitutions_are_met():
    """Every stretch of the least length with the allowed substitutions holds a hit of some mask."""
    rng = np.random.default_rng(0)
    for _ in range(3000):
        same = np.ones(s.STRETCH, bool)
        same[rng.choice(s.STRETCH, 2, replace=False)] = False
        assert any(all(same[i + o] for o in mask) for mask in s.MASKS for i in range(s.STRETCH - mask[-1]))


def test_hard_documents(spark, hard, nothing):
    benchmark = spark.createDataFrame([(1, hard.where("doc_id = 8").first()["text"])], "item_id int, text string")
    met = {r["doc_id"] for r in s.overlaps(hard, benchmark).collect()}
    assert met == {8, 18}
    assert s.clean(hard, benchmark).columns == hard.columns and s.clean(hard, benchmark).count() == hard.count() - 2
    assert s.overlaps(nothing, benchmark).collect() == [] and s.clean(nothing, benchmark).collect() == []
    assert s.overlaps(hard, benchmark.where("false")).collect() == [] and s.clean(hard, benchmark.where("false")).count() == hard.count()
