from lakeingest.llm import linewindows as lw


def brute(rows):
    """Kept text per distinct (doc_id, text), by scanning places in order."""
    rows = sorted(set(rows), key=lambda r: r[:2])
    first, out = {}, {}
    for doc_id, th, text in rows:
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if window == ("", "", ""):
                continue
            if window in first:
                gone |= {i, i + 1, i + 2}
            else:
                first[window] = (doc_id, th, i)
        out[doc_id, th] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_against_brute_force(spark, hard):
    ids = [(-1 if r["doc_id"] is None else r["doc_id"], r["h"], r["text"]) for r in hard.selectExpr("doc_id", "text", "xxhash64(text) as h").collect() if r["text"] is not None]
    want = brute(ids)
    got = lw.dedup(hard)
    assert got.columns[: len(hard.columns)] == hard.columns
    seen = 0
    for r, h in [(r, r["h0"]) for r in lw.dedup(hard.selectExpr("*", "xxhash64(text) as h0")).collect()]:
        if r["lw_lines"]:
            key = (-1 if r["doc_id"] is None else r["doc_id"], h)
            assert (r["text"], r["lw_removed"]) == want[key]
            if r["lw_removed"]:
                assert r["n_chars"] == len(r["text"])
                seen += 1
        else:
            assert r["text"] is None and r["lw_removed"] == 0
    assert got.count() == hard.count() and seen >= 3


def test_long_repeats_and_order(spark):
    passage = "\n".join(f"line {k} of a passage" for k in range(8))
    docs = spark.createDataFrame([(5, f"a\n{passage}\nb"), (2, passage), (9, f"{passage}\nc"), (3, "p\nq"), (4, "p\nq")], "doc_id int, text string")
    got = {r[0]: r[1] for r in lw.drop_repeated(docs).collect()}
    assert got == {2: passage, 5: "a\nb", 9: "c", 3: "p\nq", 4: "p\nq"}
    assert 6 not in {r[0] for r in lw.drop_repeated(docs.union(spark.createDataFrame([(6, passage)], docs.schema))).collect()}


def test_empty(nothing):
    assert lw.dedup(nothing).collect() == []
