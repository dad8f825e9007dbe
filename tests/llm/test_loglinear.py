import math
import random
import zlib
from collections import Counter

import numpy as np

from lakeingest.llm import loglinear as m


def brute_base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    toks = [[*m.tokens(t), "end"] for _, t in rows]
    counts = Counter(w for h, t in zip(held, toks) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    log = {w: math.log10(counts[w] + 0.1) for t in toks for w in t}
    norm = math.log10(n + 0.1 * (v + 1))
    return [(str(i), h, len(t), sum(counts[w] > 0 for w in t), n, sum(log[w] for w in t) - len(t) * norm) for (i, _), h, t in zip(rows, held, toks)]


def test_base_against_brute_force(spark, hard, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
    want = sorted(brute_base(rows), key=str)
    for listed in (m.LISTED, 20):  # also with most words met by the join
        monkeypatch.setattr(m, "LISTED", listed)
        got = sorted(((str(r[0]), *r[1:6]) for r in m.score(hard).collect()), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_log_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    p = m.Parameters.start(rng.dirichlet(np.ones(20)), dim=m.DIM)
    scores = lambda a, b: (p.vectors[a] @ p.near + p.vectors[b] @ p.far) @ p.vectors.T + p.bias
    table = p.log10_table()
    for a, b in ((0, 0), (3, 19), (19, 3)):
        assert math.isclose(np.log10(np.exp(scores(a, b).astype(float)).sum()), table[a, b], rel_tol=1e-5)


def test_contexts_do_not_cross_texts():
    c = m.Classes([b"x", b"y"])
    word, near, far, begin = c.encode([[], [b"x"], [b"x", b"y", b"x"]])
    x, y = c.of[b"x"], c.of[b"y"]
    assert word.tolist() == [0, x, 0, x, y, x, 0] and begin.tolist() == [0, 1, 3, 7]
    assert near.tolist() == [0, 0, x, 0, x, y, x]
    assert far.tolist() == [0, 0, 0, 0, 0, x, y]


def test_step_against_plain_sums():
    """One step follows the gradient summed token by token."""
    rng = np.random.default_rng(2)
    share = rng.dirichlet(np.ones(30))
    start = m.Parameters.start(share).flat()
    word, near, far = rng.integers(0, 30, (3, 50))
    trainer = m.Trainer(start, share)
    trainer.step(word, near, far)
    p, offset = m.Parameters.of(start), np.log(m.NOISE * share)
    noise = np.minimum(np.searchsorted(np.cumsum(share), np.random.default_rng(11).random(m.NOISE)), 29)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    vectors, a, b, bias = (np.zeros(x.shape) for x in (p.vectors, p.near, p.far, p.bias))
    for w, c, d in zip(word, near, far):
        query = p.vectors[c] @ p.near + p.vectors[d] @ p.far
        for k, real in [(w, True), *((k, False) for k in noise)]:
            g = real - sigmoid(query @ p.vectors[k] + p.bias[k] - offset[k])
            vectors[k] += g * query
            bias[k] += g
            pull = g * p.vectors[k]
            vectors[c] += p.near @ pull
            vectors[d] += p.far @ pull
            a += np.outer(p.vectors[c], pull)
            b += np.outer(p.vectors[d], pull)
    grad = np.concatenate([vectors.ravel(), a.ravel(), b.ravel(), bias]) / len(word)
    want = start + m.RATE * grad / np.sqrt(1e-6 + grad * grad)
    assert np.allclose(trainer.flat, want, atol=1e-4)


def test_classes_of_other_words_by_their_tails():
    c = m.Classes([b"x"])
    texts = [[b"x", b"ab", b"zab", b"b", b"", b"\xc3\xa9"], [b"cab", b"x"]]
    word, _, _, begin = c.encode(texts)
    want = [c.of[w] if w in c.of else 1 + m.bucket(w) for w in texts[0]] + [0] + [1 + m.bucket(b"cab"), c.of[b"x"], 0]
    assert word.tolist() == want and begin.tolist() == [0, 7, 10]


def test_model_learns_order(spark):
    """On texts with strict order the model beats the unigram base on held-out texts by far."""
    rng = random.Random(0)
    text = lambda: " ".join(f"{w} {w}x" for w in rng.choices([f"w{k}" for k in range(40)], k=120))
    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id int, text string")
    got = [r for r in m.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


def test_empty(nothing, spark):
    assert m.score(nothing).collect() == []
    only_held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id int, text string")
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in m.score(only_held).collect()} == {(0, 0, 0.0)}
