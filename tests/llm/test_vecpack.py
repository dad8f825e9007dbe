import zlib

import pytest
from pyspark.sql import functions as F

from lakeingest.llm import vecpack as v
from lakeingest.llm.tokens import Encoder, public_tokenizer

PATH = public_tokenizer("byte_bpe_50k.json")


def check(docs, limits, got, loss_from=None):
    """Every id in one piece, sequences gapless and within the limits."""
    encode = Encoder(PATH, "space_led")
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for key in {(r["doc_id"], r["text"]) for r in docs}:
        ids = encode([key[1]])[0]
        n = len(ids) // 4
        mine = sorted((p for p in pieces[key[0], n] if True), key=lambda p: p["start"])
        covered = [0] * n
        for p in mine:
            part = ids[4 * p["start"] : 4 * (p["start"] + p["length"])]
            if zlib.crc32(part) == p["ids_crc32"]:
                for k in range(p["start"], p["start"] + p["length"]):
                    covered[k] += 1
        assert min(covered) >= 1
    assert sum(r["length"] for r in got) == sum(len(x) // 4 for x in encode([r["text"] for r in docs]))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for seq in sequences.values():
        seq.sort(key=lambda r: r["offset"])
        at = 0
        for r in seq:
            assert r["offset"] == at and r["n_segments"] == len(seq)
            at += r["length"]
        assert at <= limits.tokens and len(seq) <= limits.segments and sum(r["loss_tokens"] for r in seq) <= limits.loss
    return sequences


@pytest.mark.parametrize("limits", (v.Limits(), v.Limits(256, 4, 256), v.Limits(128, 8, 40), v.Limits(64, 1, 64)))
def test_hard_documents(spark, hard, limits):
    loss = F.when(F.col("doc_id") % 2 == 0, 50)
    docs, got = hard.collect(), v.pack(hard, PATH, "space_led", limits, loss_from=loss).collect()
    check(docs, limits, got)
    for r in got:
        first = 50 if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else 0
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], first))


def test_no_padding_without_tight_limits(spark, hard):
    limits = v.Limits(segments=1000)
    sequences = check(hard.collect(), limits, v.pack(hard, PATH, "space_led", limits).collect())
    lengths = [sum(r["length"] for r in s) for s in sequences.values()]
    assert all(n & (n - 1) == 0 for n in lengths)


def test_limits_and_empty(nothing):
    with pytest.raises(ValueError):
        v.Limits(tokens=0)
    assert v.pack(nothing, PATH, "space_led").collect() == []
