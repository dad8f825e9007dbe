import random
import re
from collections import Counter

import numpy as np

from lakeingest.llm import isoforest as f
from tests.llm.conftest import prose


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(hard):
    texts = [r["text"] for r in hard.collect()]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (7, 8, 9, 16, 40, 300)]
    texts += ["a b c d e f g h a b c d e f g h i", "x|y <z>\nx|y <z>\n \n ", "é" * 5, "w\x0bv\x0cu"]
    for t in texts:
        assert f.measure(t)[0] == plain_counts(t)
    assert f.base_failed((19, 0, 0, 0, 0)) and not f.base_failed((20, 0, 0, 0, 6)) and f.base_failed((20, 0, 0, 0, 7))


def corpus(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        text = prose(rng, rng.randint(40, 200))
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_verdicts(spark):
    docs, labels = corpus(spark)
    forest = f.fit(docs, labels.where("doc_id < 200"))
    got = {r["doc_id"]: r["kept"] for r in f.judge(docs, forest).where("doc_id >= 200").collect()}
    bad = [kept for i, kept in got.items() if i % 8 == 0]
    good = [kept for i, kept in got.items() if i % 8]
    assert np.mean(bad) < 0.05 and np.mean(good) > 0.97
    kept = {r["doc_id"] for r in f.keep(docs, forest).collect()}
    assert kept == {r["doc_id"] for r in f.judge(docs, forest).where("kept").collect()}


def test_hard_documents(spark, hard, nothing):
    docs, labels = corpus(spark, 100)
    forest = f.fit(docs, labels)
    got = f.judge(hard, forest)
    assert got.count() == hard.count() and f.keep(hard, forest).columns == hard.columns
    assert {(r["n_words"], r["base_failed"], r["kept"]) for r in got.where("doc_id in (0, 1, 2)").collect()} == {(0, True, False)}
    assert f.judge(nothing, forest).collect() == []
    for none in (labels.where("false"), labels.where("quality = 1"), labels.where("quality = 0"), labels.withColumn("quality", labels.quality + None)):
        passed = f.judge(docs, f.fit(docs, none))
        assert passed.where("kept = base_failed").count() == 0


def test_the_same_rows_give_the_same_forest(spark):
    docs, labels = corpus(spark, 100)
    a, b = f.fit(docs, labels), f.fit(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(a.value, b.value) and a.threshold == b.threshold
