import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lakeingest.llm import simhash as s


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius:
                    label[i] = min(label[i], label[j])
    return [min((ids[j] for j in range(len(fps)) if label[j] == label[i]), key=lambda x: -1 if x is None else x) for i in range(len(fps))]


def test_against_brute_force(spark, hard):
    rows = [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip((str(i) for i, _ in rows), fps, map(str, plain_components([i for i, _ in rows], fps))))
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in s.group(hard).collect())
    assert got == want


def test_links_of_crowded_tiles(spark):
    """Chains and near fingerprints, with tiles cut into small parts, by one and by more blocks."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for x in list(fps):
        for _ in range(4):
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            fps.append(x)
    fps = sorted(set(fps))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    want = plain_components(fps, fps)
    for blocks in (1, 2, 3):
        tiled = spark.createDataFrame(signed, "fp bigint").select("fp", s.tile(F.col("fp"), blocks).alias("key"))
        found = s.links(tiled, s.offsets(blocks, 3), 3, 3, part=16)
        roots = {r["node"] % (1 << 64): r["root"] for r in s.components(found.selectExpr("fp as x", "low as y")).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(roots.get(x, x if x < 1 << 63 else x - (1 << 64)), set()).add(x)
        assert sorted(map(min, groups.values())) == sorted(set(want))
        assert {x: min(g) for g in groups.values() for x in g} == dict(zip(fps, want))


def test_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id as x", "id - 1 as y")
    assert {r["root"] for r in s.components(edges).collect()} == {0}
    assert s.components(edges.where("x < 0")).collect() == []


def test_one_of_each_group_stays(spark, hard):
    kept = s.keep_one(hard)
    assert kept.columns == hard.columns
    groups = {(r["component_id"], r["component_th"]) for r in s.group_similar(hard).collect()}
    assert kept.count() == len(groups)
    assert 5 not in {r["doc_id"] for r in kept.collect()}


def test_similar_texts_are_linked_and_others_are_not(spark):
    """Copies with some words replaced, by their share of equal five-word shingles."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, similar = [], {}
    for i in range(120):
        text = [word() for _ in range(int(rng.integers(60, 400)))]
        copy = list(text)
        for at in rng.choice(len(copy), max(1, len(copy) * (i % 12) // 100), replace=False):
            copy[at] = word()
        rows += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
        a, b = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (text, copy))
        similar[i] = len(a & b) / len(a | b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in s.group_similar(docs).collect()}
    assert all(got[i] == i for i in range(120)) and set(got.values()) <= set(range(120)) | {1000 + i for i in range(120)}
    linked = {i for i in range(120) if got[1000 + i] == i}
    assert {i for i, x in similar.items() if x >= 0.88} <= linked <= {i for i, x in similar.items() if x >= 0.65}
    assert len(linked & {i for i, x in similar.items() if x >= 0.8}) >= 0.9 * sum(x >= 0.8 for x in similar.values())
    assert {r["doc_id"] for r in s.keep_one(docs).collect()} == set(got.values())


def test_only_exact_similarity_links(spark):
    """Pairs at any similarity about 0.8, short ones too: those of 0.8 and more are linked, and no others."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows, want = [], set()
    for i in range(300):
        text = [word() for _ in range(int(rng.integers(8, 300)))]
        copy = text[: len(text) - int(rng.integers(0, len(text) // 3))] + [word() for _ in range(int(rng.integers(0, 3)))]
        a, b = ({tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in (text, copy))
        rows += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
        if len(a & b) / len(a | b) >= 0.8:
            want.add(i)
    got = {r["doc_id"]: r["component_id"] for r in s.group_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in range(300) if got[1000 + i] == i} == want and 50 < len(want) < 250


def test_verified_links_over_parts(spark):
    """A chain of neighbours of 0.9, cut into many parts, stays one component; a neighbour of 0.7 is none."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[6 * k : 6 * k + 120]) for k in range(40)] + [" ".join(words[:100] + [f"v{k}" for k in range(20)])]
    fps = [(s.wide_fingerprint(t)[0], b"r", np.unique(s._hashes(t, 5)).tobytes()) for t in texts]
    sets = spark.createDataFrame(fps, "fp binary, root binary, shingles binary")
    for part in (5, 1024):
        found = s.verified(sets, 0.8, s.WIDE_RADIUS, s.FIRST_RADIUS, part=part)
        roots = {bytes(r["node"]): bytes(r["root"]) for r in s.components(found.selectExpr("fp as x", "low as y")).collect()}
        assert len({roots.get(f, f) for f, _, _ in fps[:40]}) == 1 and fps[40][0] not in roots


def test_empty(nothing):
    assert s.group(nothing).collect() == [] and s.keep_one(nothing).collect() == []


def test_wide_tiles_by_population_counts(spark):
    """Near fingerprints of like sizes lie in near tiles; those whose population counts alone tell them apart do not."""
    rng = np.random.default_rng(4)
    radius, similar = s.WIDE_RADIUS, s.SIMILAR
    rows, near = [], []
    for k in range(400):
        bits = rng.random(64 * s.WORDS) < rng.choice([0.05, 0.25, 0.35, 0.5, 0.65, 0.95])
        other = bits.copy()
        value = rng.random() < 0.5  # all flips in one direction move the count the most
        places = np.flatnonzero(bits == value)
        flipped = rng.permutation(places)[: rng.integers(0, radius + 1)]
        other[flipped] = ~other[flipped]
        size = int(rng.integers(1, 500))
        rows += [(2 * k, size, int(bits.sum())), (2 * k + 1, int(np.ceil(size * similar)), int(other.sum()))]
        near.append((2 * k, 2 * k + 1))
    key, steps = s.wide_tile(F.col("size"), F.col("ones"), similar, radius)
    got = spark.createDataFrame(rows, "k long, size long, ones long").select("k", "size", "ones", key.alias("key")).collect()
    keys = {r["k"]: r["key"] for r in got}
    assert all(abs(keys[a] - keys[b]) in steps for a, b in near)
    apart = [(a, b) for a in got for b in got if a["size"] == b["size"] and abs(a["ones"] - b["ones"]) > 2 * s.WIDE_STEP]
    assert apart and not any(abs(a["key"] - b["key"]) in steps for a, b in apart)


def test_wide_fingerprints_carry_their_population_counts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, "a b")], "doc_id int, text string")
    for r in s.fingerprints(docs, s.WIDE_SHINGLE, wide=True).collect():
        assert r["ones"] == sum(x.bit_count() for x in r["fp"][: 8 * s.WORDS])


def test_no_pair_is_lost_by_chance(spark):
    """Pairs of exactly 0.8 whose fingerprints lie beyond the radius, of all words or of the first, are linked."""
    rows = []
    for k in (972, 1774, 4753, 5036, 15992):
        words = [f"w{k}x{i}" for i in range(9)]
        texts = " ".join(words[:8]), " ".join(words)
        a, b = (np.frombuffer(s.wide_fingerprint(t)[0], np.uint64)[: s.WORDS] for t in texts)
        differ = np.bitwise_count(a ^ b)
        assert differ[0] > s.FIRST_RADIUS or differ.sum() > s.WIDE_RADIUS
        rows += [(k, texts[0]), (100_000 + k, texts[1])]
    found = s.group_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] % 100_000 for r in found)


def test_odd_sketches_rule_nothing_similar_out():
    """Sets of any size, over lengths of sketches and parts: whatever reaches 0.8 is linked, and little else."""
    rng = np.random.default_rng(5)
    sets, pairs = [], []
    for k in range(150):
        n = int(rng.choice([1, 4, 9, 60, 500, 640, 700, 1300, 3000]))
        union = rng.integers(0, 1 << 63, 2 * n + 2).astype(np.uint64)
        gone, more = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 5 + 1))
        a, b = np.unique(union[:n]), np.unique(np.append(union[gone:n], union[n : n + more]))
        shared = len(np.intersect1d(a, b))
        pairs.append((2 * k, 2 * k + 1, shared / max(1, len(a) + len(b) - shared)))
        sets += [a, b]
    sizes = np.array([len(x) for x in sets])
    assert len({len(s.odd_sketch(x)) for x in sets}) > 3
    order = rng.permutation(len(sets))
    for of in (order, np.argsort(sizes, kind="stable")):
        at = np.argsort(of)
        # All sketches are folded to the shortest here, which leaves the most pairs that are none.
        label = s.odd_forest(s.folded([s.odd_sketch(sets[i]) for i in of]), sizes[of], 0, 0.8)
        assert all(label[at[a]] == label[at[b]] for a, b, x in pairs if x >= 0.8)
    for a, b, x in pairs:  # two by two, as in a tile of like sizes
        label = s.odd_forest(s.folded([s.odd_sketch(sets[a]), s.odd_sketch(sets[b])]), sizes[[a, b]], 1, 0.8)
        assert (label[1] == 0) or x < 0.8
        assert label[1] == 1 or x >= 0.6
    assert sum(x >= 0.8 for _, _, x in pairs) > 20
