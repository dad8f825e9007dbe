"""URL filter: rules, and for the rest naive Bayes over segmented host names and path tokens.

Host names are split into words by the most probable segmentation under unigram counts of the words in the
pages' own texts (Viterbi). Segmented host words and path tokens are hashed into a fixed number of features; the
pages on which a rule decides give the counts of a multinomial naive Bayes model, which judges the others.

Counts cover all pages and are combined in tasks. What goes out to tasks is bounded: the word list (the most
frequent words, at most ``LISTED``) and the feature counts. No page is grouped by host, so hot hosts are no key.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and is judged by the
model's prior; without pages under rules everything else is allowed; ties go to allow; repeated rows are judged
alike; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import by_bytes, frequent, stored
from lakeingest.llm.tokens import worker_cache

#: (verdict, host and path) of the rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LISTED, LONGEST, FEATURES, HELD = 50_000, 20, 1 << 16, 300_000
VERDICTS = ("allow", "block")
_UPPER = {c: c + 32 for c in range(65, 91)}
_TAG = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_WORD = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[a-z]+|[0-9]+")
_PATH = re.compile(r"[^\W\d_]+|\d+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    head = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return head.translate(_UPPER), re.split(r"[?#]", rest[len(head) :], maxsplit=1)[0]


class Rules:
    """The longest rule whose host is the url's or above it and whose path begins the url's."""

    def __init__(self, rules=RULES):
        self.rules = []
        for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
            host, slash, path = rule.partition("/")
            self.rules.append((verdict, rule, host, slash + path))

    def of(self, host: str, path: str) -> tuple[str, str] | None:
        for verdict, rule, above, begin in self.rules:
            if (host == above or host.endswith("." + above)) and path.startswith(begin):
                return verdict, rule
        return None


class Segmenter:
    """Most probable split of a run of letters into words."""

    def __init__(self, counts: dict[str, int]):
        total = max(sum(counts.values()), 1)
        self.cost = {w: -np.log(c / total) for w, c in counts.items()}
        # Unlisted words: ten at each length's tenth of a chance, so that long strange words stay whole.
        self.unlisted = [-np.log(10 / total) + n * np.log(10) for n in range(64)]

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            least, where = np.inf, end - 1
            for begin in range(max(0, end - LONGEST), end):
                cost = best[begin] + self.cost.get(run[begin:end], self.unlisted[end - begin])
                if cost < least:
                    least, where = cost, begin
            best.append(least)
            back.append(where)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]


def features(host: str, path: str, segment: Segmenter, memo: dict[str, list[int]]) -> list[int]:
    """Hashed host words and path tokens, repeats included; numbers count as one token."""
    known = memo.get(host)
    if known is None:
        found = ["h:" + w for part in _PARTS.findall(host) for w in (segment.split(part) if part.isalpha() else ["0"])]
        known = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in found]
        if len(memo) < HELD:
            memo[host] = known
    tokens = ("p:" + ("0" if t[0].isdigit() else t.lower()) for t in _PATH.findall(path))
    return known + [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in tokens]


def word_counts(pages: DataFrame) -> dict[str, int]:
    """The most frequent words of the pages' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for b in by_bytes(batches, "html"):
            for html in b.column(0).to_pylist():
                held.update(w for w in _WORD.findall(_TAG.sub(" ", html or "").translate(_UPPER)) if len(w) <= LONGEST)
            if len(held) > HELD:
                yield sent()
                held.clear()
        yield sent()

    words = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(run, "word string, c bigint")
    counted = words.groupBy("word").agg(F.sum("c").alias("c"))
    return frequent(stored(counted, "page-words")[0], LISTED)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page."""
    segment, ruled = Segmenter(word_counts(pages)), Rules(rules)
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    mark = str(zlib.crc32(repr(sorted(segment.cost.items())[:1000]).encode()))

    def read(batches: Iterator[pa.RecordBatch]):
        memo = worker_cache().setdefault(("hosts", mark), {})
        for b in by_bytes(batches, "url"):
            yield b.column(0), [(h, p, ruled.of(h, p), features(h, p, segment, memo)) for h, p in map(split_url, b.column(1).to_pylist())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for _, found in read(batches):
            for _, _, rule, feats in found:
                if rule:
                    k = VERDICTS.index(rule[0])
                    rows[k] += 1
                    np.add.at(sums[k], feats, 1)
        k, f = np.nonzero(sums)
        columns = [np.concatenate([k, [0, 1]]), np.concatenate([f, [-1, -1]]), np.concatenate([sums[k, f], rows])]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["k", "f", "n"])

    counts, rows = np.zeros((2, FEATURES)), np.zeros(2)
    for r in urls.mapInArrow(count, "k bigint, f bigint, n bigint").groupBy("k", "f").agg(F.sum("n").alias("n")).collect():
        if r["f"] < 0:
            rows[r["k"]] = r["n"]
        else:
            counts[r["k"], r["f"]] = r["n"]
    used = max(int((counts.sum(0) > 0).sum()), 1)
    weight = np.log(counts + 1) - np.log(counts.sum(1, keepdims=True) + used + 1)
    lean = (weight[1] - weight[0]).astype(np.float32)
    lean[counts.sum(0) == 0] = 0.0  # features that no rule's page has say nothing
    prior = float(np.log(rows[1] + 1) - np.log(rows[0] + 1)) if rows.any() else -np.inf

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in read(batches):
            said = [rule[0] if rule else VERDICTS[int(prior + float(lean[feats].sum()) > 0)] for _, _, rule, feats in found]
            strings = [[x[0] for x in found], [x[1] for x in found], [x[2] and x[2][1] for x in found], said]
            yield pa.record_batch([ids, *[pa.array(s, pa.string()) for s in strings]], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(verdicts, "page_id bigint, host string, path string, rule string, verdict string")
