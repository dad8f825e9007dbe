import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakeingest.llm import align as al
from lakeingest.llm import chunks
from lakeingest.llm.queries import op11_token_links
from lakeingest.llm.tokens import public_tokenizer
from tests.conftest import SF_DIR

PATHS = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 173 or c > 173]
    table = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    bytes_a = {i: bytes(table.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    return a, b, bytes_a, bytes_b


def tokens(libraries, text):
    """Ids and byte ends of both tokenizers, whole text at once."""
    a, b, bytes_a, bytes_b = libraries
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    want = (" " + text).encode()
    if b"".join(bytes_a[i] for i in ids_a) != want or b"".join(bytes_b[i] for i in ids_b) != want:
        return [], []
    out = []
    for ids, table in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, rows = 0, []
        for i in ids:
            rows.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(rows)
    return out


def brute(libraries, rows):
    """The contract, document by document, with sets of byte offsets."""
    found, count = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(libraries, text)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, ending = [([], []) for _ in ends], {t[2]: t[0] for t in b}
        for k, side in enumerate((a, b)):
            for t in side:
                groups[bisect_left(ends, t[2])][k].append(str(t[0]))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in groups]
        links = [(t[0], ending[t[2]]) for t in a if t[2] in ending]
        count.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        overlaps = sum(t[1] < u[2] and u[1] < t[2] for t in a for u in b) if len(a) < 400 else None
        found.append((doc_id, len(a), len(b), len(groups), links, overlaps, digest))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(i, na, nb, ng, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), d, o) for i, na, nb, ng, ls, o, d in found]


def check(libraries, docs, got):
    key = lambda r: tuple((x is not None, x) for x in r[:8])
    want = sorted(brute(libraries, [(r["doc_id"], r["text"]) for r in docs]), key=key)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
    rows = sorted([tuple(r[n] for n in names) for r in got], key=key)
    assert [r[:8] for r in rows] == [w[:8] for w in want]
    assert all(w[8] is None or r[8] == w[8] for r, w in zip(rows, want))


@pytest.mark.parametrize("items", (1, 300, chunks.ITEMS))
def test_hard_documents(spark, hard, libraries, items):
    docs = hard.select("doc_id", "text").union(spark.createDataFrame(
        [(200, "a▁b other bytes"), (201, "a  b"), (202, " led"), (203, "ends "), (204, "<s> </s> <0x0A> <|endoftext|>"), (205, "ﬁ é \x00 \x1c　 z")],
        "doc_id bigint, text string"))
    check(libraries, docs.collect(), al.align(docs, *PATHS, items).collect())


def test_random_white_space_and_marks(spark, libraries):
    rng = random.Random(8)
    alphabet = "   \n\t\x85　abs'Z9é́日😀#▁"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(libraries, docs.collect(), al.align(docs, *PATHS, 400).collect())


def test_query_on_whole_documents(spark, libraries):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    check(libraries, docs, op11_token_links(spark, SF_DIR).collect())


def test_links_of_documents(spark, hard, libraries):
    docs = hard.where("length(text) < 1500 or text is null")
    got = {}
    for r in al.links(docs, *PATHS).collect():
        got.setdefault((r["doc_id"], r["kind"]), Counter())[tuple(r)[2:]] += 1
    for doc_id in (0, 3, 5, 6, 26):
        text = next(r["text"] for r in docs.collect() if r["doc_id"] == doc_id)
        a, b = tokens(libraries, text)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        group = lambda t: next(k for k, e in enumerate(ends) if t[2] <= e)
        overlap = {(i, j, x[0], y[0], min(x[2], y[2]) - max(x[1], y[1]), x[2] == y[2])
                   for i, x in enumerate(a) for j, y in enumerate(b) if min(x[2], y[2]) > max(x[1], y[1])}
        shared = {(i, j, x[0], y[0], 1, x[2] == y[2]) for i, x in enumerate(a) for j, y in enumerate(b) if group(x) == group(y)}
        assert set(got.get((doc_id, "overlap"), ())) == overlap and set(got.get((doc_id, "group"), ())) == shared


@pytest.mark.parametrize("most", (1, 7, 1 << 20))
def test_products(most):
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, m, k = rng.integers(1, 9, 3)
        dense = [rng.integers(0, 3, shape) * (rng.random(shape) < 0.5) for shape in ((n, m), (m, k))]
        sparse = []
        for d in dense:
            row, column = np.nonzero(d)
            sparse.append(al.CSR(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(d)))]), column, d[row, column], d.shape[1]))
        out = np.zeros((n, k), int)
        for r, c, v in sparse[0].product(sparse[1], most):
            assert (out[r, c] == 0).all()
            out[r, c] = v
        assert np.array_equal(out, dense[0] @ dense[1])
        back = sparse[0].transposed()
        assert back.rows == m and all(np.array_equal(back.indices[s:e], np.flatnonzero(dense[0][:, i])) for i, (s, e) in enumerate(zip(back.indptr, back.indptr[1:])))


def test_empty_table(nothing):
    assert al.align(nothing, *PATHS).collect() == []
    assert al.links(nothing, *PATHS).collect() == []
    with pytest.raises(ValueError):
        al.Alignment(np.array([2]), np.array([1]))
