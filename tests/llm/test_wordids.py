import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lakeingest.llm import chunks, wordids
from lakeingest.llm.queries import op12_word_ids
from lakeingest.llm.tokens import public_tokenizer
from tests.conftest import SF_DIR

PATH, PATTERN = public_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def whole(library, text):
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


@pytest.mark.parametrize("items", (1, 500, chunks.ITEMS))
def test_hard_documents(spark, hard, library, items):
    got = wordids.decode(wordids.encode(hard, PATH, PATTERN, items), PATH, PATTERN).collect()
    want = [(r["doc_id"], whole(library, r["text"]), (r["text"] or "").encode()) for r in hard.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(r["doc_id"], bytes(r["ids"]), bytes(r["data"])) for r in got], key=key) == sorted(want, key=key)


def test_random_white_space_and_marks(spark, library):
    rng = random.Random(4)
    alphabet = "  \n\t\r\x1c\x85  　ab'sZ9é́日😀#​"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (bytes(r["ids"]), bytes(r["data"])) for r in wordids.decode(wordids.encode(docs, PATH, PATTERN, 800), PATH, PATTERN).collect()}
    assert got == {i: (whole(library, t), t.encode()) for i, t in enumerate(texts)}


def test_query_on_whole_documents(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op12_word_ids(spark, SF_DIR).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in docs:
        ids = whole(library, r["text"])
        want[r["doc_id"]] = len(ids) // 4, digest(ids), digest((r["text"] or "").encode())
    assert got == want


def test_a_word_is_encoded_once(spark, monkeypatch):
    words = spark.createDataFrame([(w, c, s) for c in range(300) for s, w in enumerate(("same", "also"))], wordids._WORDS)
    calls = spark.sparkContext.accumulator(0)
    real = wordids.Ranks

    class Counting:
        @staticmethod
        def shared(path, pattern):
            held = real.shared(path, pattern)

            class Once:
                def word(self, w):
                    calls.add(1)
                    return held.word(w)

            return Once()

    monkeypatch.setattr(wordids, "Ranks", Counting)
    assert wordids._encoded_words(words, PATH, PATTERN).count() >= 300
    assert calls.value == 2


def test_empty_table_and_unknown_ids(spark, nothing):
    assert wordids.decode(wordids.encode(nothing, PATH, PATTERN), PATH, PATTERN).collect() == []
    ids = np.array([50_300], "<u4").tobytes()
    odd = spark.createDataFrame([(1, bytearray(ids))], "doc_id bigint, ids binary")
    with pytest.raises(Exception, match="no bytes"):
        wordids.decode(odd, PATH, PATTERN).collect()
    assert wordids.decode(spark.createDataFrame([(None, None)], "doc_id bigint, ids binary"), PATH, PATTERN).collect() == [(None, b"", b"")]


@pytest.mark.parametrize("values", ([], [0], [0, 0, 7], [1 << 31, 5, 255, 256, 70_000]))
def test_packed_integers(values):
    assert chunks.unpack_ints(chunks.pack_ints(np.array(values, "<u4"))).tolist() == values
