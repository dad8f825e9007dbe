"""Main text of HTML pages by wrappers: union-free regular expressions inferred per host.

A page becomes a stream of tokens, one per text block, named by the path of block elements around it. Runs and
periods in the stream fold into repeated groups. Streams of a host are aligned one after the other: matching
tokens merge (differing texts make a slot, equal texts stay constants), and what only one side has becomes
optional. The wrapper tells in which container the host's variable text lies, and which constants inside it
belong to the template. A page's text is what lies in that container, without blocks of menus, notices and the
like, which their elements, roles and class names show.

Tasks merge the pages that they hold into one wrapper per host before anything is shuffled; these partial
wrappers merge in two steps, so that a frequent host is no single group of many rows. All pages take part.
The table of wrappers is joined to the pages without a hint: Spark broadcasts it only if it measures small.

Defined results: null or empty html gives an empty text; a null url has the empty host; a page of a host of
its own is judged by its own stream; repeated rows give equal texts; extra columns are not read.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeingest.llm.common import by_bytes, stored
from lakeingest.llm.hostwords import split_url

#: Partial wrappers that a task holds, longest period that folds, parts of a host's first merge.
HELD, PERIOD, SALTS = 2_000, 4, 32
#: A constant inside the main container is the template's if so many pages, all that the wrapper saw, have it.
CONSTANT_PAGES = 4

# Elements by their part in a page.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr "
                   "ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style noscript template iframe svg math object canvas audio video select button textarea title "
                  "datalist map".split())
_OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}
_OUTSIDE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments respond reply replies discussion disqus pagination pager skip copyright legal disclaimer".split())
_OUTSIDE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form toolbar".split())
#: A class that begins so tells a state of the element, not what it is: ``has-sidebar``.
_STATES = frozenset("has with without no is show hide layout page theme".split())
_MAIN_NAMES = frozenset("article main content post entry story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|([^<]+|<)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_LETTERS = re.compile(r"[a-zA-Z]+")


def _opened(tag: str, attributes: str, by_name: bool) -> tuple[str, bool, bool]:
    """A token for the path, and whether the element lies outside the main text, or is a main container.

    ``by_name``: class and id count as signs of what lies outside.
    """
    outside, main, names = tag in _OUTSIDE, tag in ("article", "main"), []
    if attributes:
        for name, *values in _NAMED.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                outside = True
            elif name == "role":
                outside = outside or value in _OUTSIDE_ROLES
                main = main or value in ("main", "article")
            elif name in ("class", "id"):
                words = [w for part in value.split() if not any(c.isdigit() for c in part) for w in _LETTERS.findall(part)]
                names += words[:2]
                if by_name and tag not in ("body", "html"):
                    for part in value.split():
                        said = _LETTERS.findall(part)
                        outside = outside or said and said[0] not in _STATES and not _OUTSIDE_NAMES.isdisjoint(said)
                main = main or not _MAIN_NAMES.isdisjoint(words) and tag in ("div", "section", "td")
    return ".".join([tag, *sorted(names)[:2]]), bool(outside), main and not outside


def read_blocks(html: str | None) -> list[tuple[str, str, bool, str]]:
    """``(path, text, outside, container)`` of every text block; ``container`` is the path of the innermost main container or empty.

    Where names leave nothing inside, they were misread, and only elements and roles count.
    """
    found = _blocks(html, True)
    return found if not found or any(not b[2] for b in found) else _blocks(html, False)


def _blocks(html: str | None, by_name: bool) -> list[tuple[str, str, bool, str]]:
    out: list[tuple[str, str, bool, str]] = []
    stack: list[tuple[str, str, bool, str]] = [("", "", False, "")]
    text: list[str] = []
    skip, depth, source = "", 0, html or ""
    inner: list[str] = []  # block elements open in the skipped one
    begun, unclosed = 0, set()

    def flush() -> None:
        if text:
            words = " ".join(html_lib.unescape("".join(text)).split())
            if words:
                _, path, outside, container = stack[-1]
                out.append((path, words, outside, container))
            text.clear()

    def close_to(k: int) -> None:
        flush()
        del stack[k:]

    at, size = 0, len(source)
    match = _TOKEN.match
    while at < size or skip:
        if at >= size:  # never closed, nor its parent: what follows is read, the tag is not
            unclosed.add(skip)
            at, skip = begun, ""
            continue
        m = match(source, at)
        at = m.end()
        closing, tag, attributes, plain = m.groups()
        if plain is not None:
            if not skip:
                text.append(plain)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if skip:
            if tag == skip:
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
            elif not closing and tag in ("script", "style"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else at
            elif tag in _BLOCK and tag not in _VOID and not closing:
                inner.append(tag)
            elif closing and tag in inner:
                while inner.pop() != tag:
                    pass
            elif closing and any(x[0] == tag for x in stack):
                skip = ""  # left open: it ends with its parent
            if skip or tag not in _BLOCK:
                continue
        if tag in _SKIP and tag not in unclosed and not closing:
            if tag in ("script", "style", "textarea", "title"):  # raw text up to the end tag
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
            elif not attributes.endswith("/"):
                skip, depth, begun = tag, 1, at
                inner.clear()
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag in ("td", "th"):
            text.append(" ")
        elif tag in _BLOCK:
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close_to(k)
                        break
                else:
                    flush()
                continue
            flush()
            if tag in _VOID:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or stack[k][0] in _ENDS.get(tag, ()):
                    close_to(k)
                    break
                if stack[k][0] not in _HEADING:
                    break
            name, outside, main = _opened(tag, attributes, by_name)
            _, path, above, container = stack[-1]
            path = f"{path}>{name}" if path else name
            if tag == "header":  # of the site, or of an article, of which headings stay
                outside = outside or not container
            if container and above is False and ">header" in path[len(container) :] and tag not in _HEADING:
                outside = True
            headed = tag in _HEADING and stack[-1][0] == "header" and bool(container)
            outside = (above and not headed) or outside
            stack.append((tag, path, outside, path if main and not outside else container))
    flush()
    return out


Node = list  # [paths, repeated, optional, constant text's crc or None, pages, characters, container, outside]


def stream(blocks: list[tuple[str, str, bool, str]]) -> list[Node]:
    """The nodes of one page: a node per block, then runs and periods folded into repeated groups."""
    nodes: list[Node] = [[[p], False, False, zlib.crc32(t.encode("utf-8", "surrogatepass")), 1, len(t), c, o] for p, t, o, c in blocks]
    for period in range(1, PERIOD + 1):
        i, folded = 0, []
        while i < len(nodes):
            n = 1
            if i + 2 * period <= len(nodes):
                key = [x[0] for x in nodes[i : i + period]]
                while [x[0] for x in nodes[i + n * period : i + (n + 1) * period]] == key:
                    n += 1
            if n > 1:
                group = nodes[i : i + n * period]
                paths = [p for x in group[:period] for p in x[0]]
                folded.append([paths, True, False, None, 1, sum(x[5] for x in group), group[0][6], all(x[7] for x in group)])
                i += n * period
            else:
                folded.append(nodes[i])
                i += 1
        nodes = folded
    return nodes


def align(left: list[Node], right: list[Node]) -> list[Node]:
    """One wrapper of two: matching nodes merge, the others become optional."""
    a, b = [">>".join(x[0]) for x in left], [">>".join(x[0]) for x in right]
    if a == b:
        return [_merged(x, y) for x, y in zip(left, right)]
    out, i, j = [], 0, 0
    for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        out += [[*x[:2], True, *x[3:]] for x in left[i : m.a]] + [[*x[:2], True, *x[3:]] for x in right[j : m.b]]
        out += [_merged(x, y) for x, y in zip(left[m.a : m.a + m.size], right[m.b : m.b + m.size])]
        i, j = m.a + m.size, m.b + m.size
    return out


def _merged(x: Node, y: Node) -> Node:
    same = x[3] if x[3] == y[3] else None
    return [x[0], x[1] or y[1], x[2] or y[2], same, x[4] + y[4], x[5] + y[5], x[6], x[7] and y[7]]


def decide(wrapper: list[Node]) -> dict:
    """The main container of a host, and the constants in it that belong to the template."""
    inside = [x for x in wrapper if not x[7]]
    # Repeated groups have no text to compare: unless another node differs between pages, nothing tells what varies.
    differ = any(x[2] or x[3] is None and not x[1] for x in inside)
    varying = [x for x in inside if x[3] is None or x[2] and x[4] == 1] if differ else inside
    varying = varying or inside
    named = [x for x in varying if x[6]] or [x for x in inside if x[6]]
    if not varying:
        return {"named": False, "at": None, "drop": []}
    if named:
        return {"named": True, "at": "", "drop": _template(inside, lambda x: bool(x[6]))}
    # The lowest element above all varying text.
    at = ">".join(commonprefix([p.split(">")[:-1] for x in varying for p in x[0]]))
    return {"named": False, "at": at, "drop": _template(inside, lambda x: _below(x[0][0], at))}


def _template(inside: list[Node], main) -> list[int]:
    """Constants among the main nodes, if other main nodes show that the pages differ."""
    nodes = [x for x in inside if main(x)]
    if not any(x[3] is None and not x[1] for x in nodes) and not any(x[1] and x[4] > 1 for x in nodes):
        return []
    return sorted({x[3] for x in nodes if x[3] is not None and not x[1] and not x[2] and x[4] >= CONSTANT_PAGES})


def _below(path: str, at: str) -> bool:
    return path == at or not at or path.startswith(at + ">")


def extract(html: str | None, rule: dict | None) -> str:
    """The blocks of one page that the host's rule selects."""
    blocks = read_blocks(html)
    rule = rule or decide(stream(blocks))
    if rule["at"] is None:
        return ""
    drop, parts = set(rule["drop"]), []
    has_named = any(c and not o for _, _, o, c in blocks)
    own = rule if has_named == rule["named"] else decide(stream(blocks))  # a page unlike its host's others
    if own["at"] is None:
        return ""
    for path, text, outside, container in blocks:
        if outside or not (bool(container) if own["named"] else _below(path, own["at"])):
            continue
        if drop and zlib.crc32(text.encode("utf-8", "surrogatepass")) in drop:
            continue
        parts.append(text)
    return "\n\n".join(parts)


def infer(pages: DataFrame) -> DataFrame:
    """``(host, rule)``: the decision of every host's wrapper, over all its pages."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Node]] = {}

        def sent() -> pa.RecordBatch:
            columns = [list(held), [zlib.crc32(json.dumps(w).encode()) % SALTS for w in held.values()], [json.dumps(w) for w in held.values()]]
            kinds = pa.string(), pa.int32(), pa.string()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "salt", "wrapper"])

        for b in by_bytes(batches, "html"):
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host, nodes = split_url(url)[0], stream(read_blocks(html))
                held[host] = align(held[host], nodes) if host in held else nodes
            if len(held) > HELD:
                yield sent()
                held.clear()
        yield sent()

    def merged(frame: pd.DataFrame) -> list[Node]:
        wrapper = None
        for text in sorted(frame["wrapper"]):
            nodes = json.loads(text)
            wrapper = nodes if wrapper is None else align(wrapper, nodes)
        return wrapper or []

    def some(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(merged(frame))]})

    def all_of(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "rule": [json.dumps(decide(merged(frame)))]})

    found = pages.select("url", "html").mapInArrow(partial, "host string, salt int, wrapper string")
    parts = found.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(all_of, "host string, rule string")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    rules, _ = stored(infer(rows), "wrappers")
    # The host as ``split_url`` has it, in column functions, for the join.
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    met = rows.withColumn("host", host).join(rules, "host", "left").select("page_id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in by_bytes(batches, "html"):
            texts = []
            for html, rule in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if rule is not None and rule not in known:
                    if len(known) > HELD:
                        known.clear()
                    known[rule] = json.loads(rule)
                texts.append(extract(html, known.get(rule)))
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
