"""Byte access to single files from inside a task, on any file system Arrow knows."""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Iterator
from itertools import batched
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from lakeingest.functions.files import HEAD_BYTES
from lakeingest.session import spread

BLOCK = 1 << 20
BATCH_BYTES = 16 << 20
#: Entries of a folder that a task holds at once.
LISTED_ROWS = 4096
#: Folders that a task lists in each round before it hands the waiting ones on.
WALK_BUDGETS = (1, 64, 4096)


def resolve(path: str):
    """``(filesystem, path)`` for a path or URI as Spark's listing prints it (not escaped)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{quote(rest)}")


def open_input(path: str):
    fs, name = resolve(path)
    return fs.open_input_file(name)


def write_bytes(path: str, data: bytes) -> None:
    fs, name = resolve(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(name) as out:
        out.write(data)


def scan_uri(path: str) -> str:
    """The escaped form of a path, as ``_metadata.file_path`` prints it."""
    illegal = lambda m: "".join(f"%{b:02X}" for b in m[0].encode())
    return re.sub(r'[\x00-\x20"<>\\^`{|}%\[\]#?\x7f-\xa0\u1680\u2000-\u200a\u2028-\u202f\u205f\u3000]', illegal, path)


def list_tree(roots: DataFrame) -> DataFrame:
    """All files below the roots (column ``path``) as ``(path, uri, length)``.

    Every round lists folders breadth first, up to a number that grows from round to round, and then
    deals the folders still waiting out to all tasks again; the last round walks what is left. So the
    work spreads however the tree is shaped. Unlike Spark's own listing this keeps empty files, which
    have to be reported.
    """

    def entries(path: str) -> Iterator[tuple]:
        fs, name = resolve(path)
        info = fs.get_file_info(name)
        if info.type != pafs.FileType.Directory:
            yield path, info.type == pafs.FileType.File, info.size or 0
            return
        found = _scanned(name) if isinstance(fs, pafs.LocalFileSystem) else (
            (i.base_name, i.type == pafs.FileType.File, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(name)))
        for base, is_file, size in found:
            yield f"{path.rstrip('/')}/{base}", is_file, size

    def walk(budget: int | None):
        def run(batches):
            listed = 0
            for batch in batches:
                known = batch["is_file"].astype(bool)
                yield batch[known]
                waiting = deque(batch[~known]["path"])
                while waiting and (budget is None or listed < budget):
                    listed += 1
                    for some in batched(entries(waiting.popleft()), LISTED_ROWS):
                        level = pd.DataFrame(some, columns=["path", "is_file", "length"])
                        files = level["is_file"].astype(bool)
                        yield level[files]
                        waiting.extend(level[~files]["path"])
                yield pd.DataFrame([(p, False, 0) for p in waiting], columns=["path", "is_file", "length"])
        return run

    def with_uri(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "uri": [scan_uri(p) for p in batch["path"]], "length": batch["length"]})

    schema = "path string, is_file boolean, length bigint"
    level = roots.selectExpr("path", "false AS is_file", "0L AS length")
    for budget in WALK_BUDGETS:
        level = spread(level.mapInPandas(walk(budget), schema), "path")
    return level.mapInPandas(walk(None), schema).mapInPandas(with_uri, "path string, uri string, length bigint")


def remove_folders(paths: DataFrame) -> None:
    """Remove the folders of a table (column ``path``), those that are still there, by tasks."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, name = resolve(path)
                if fs.get_file_info(name).type == pafs.FileType.Directory:
                    fs.delete_dir(name)
            yield pd.DataFrame({"n": [len(batch)]})

    paths.select("path").mapInPandas(remove, "n bigint").count()


def _scanned(folder: str) -> Iterator[tuple]:
    """``(name, is_file, length)`` of a local folder's entries, of which none is held; vanished ones are left out."""
    with os.scandir(folder) as found:
        for entry in found:
            try:
                is_file = entry.is_file()
                size = entry.stat().st_size if is_file else 0
                if is_file or entry.is_dir():
                    yield entry.name, is_file, size
            except FileNotFoundError:
                continue


def _with_columns(files: DataFrame, schema: str, add) -> DataFrame:
    """Append task-side columns to a listing; ``add(path)`` gives their values for one file.

    The listing's partitioning is kept, and its other columns travel along instead of being joined
    back. Rows leave in batches of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[dict] = []
            start = size = 0
            for i, path in enumerate(batch["path"]):
                held.append(add(path))
                size += sum(len(v) for v in held[-1].values() if isinstance(v, bytes))
                if size > BATCH_BYTES or i + 1 == len(batch):
                    part = batch.iloc[start:i + 1].reset_index(drop=True)
                    yield part.assign(**{name: [h[name] for h in held] for name in held[0]})
                    held, start, size = [], i + 1, 0

    before = ", ".join(f"{n} {t}" for n, t in files.dtypes)
    return files.mapInPandas(run, f"{before}, {schema}")


def read_heads(files: DataFrame) -> DataFrame:
    """Add the first 100 KB of every file as ``head``, or ``read_error``.

    Only the head is fetched, so the cost follows the number of files and not their size. Where the
    header record of a delimited file is longer, ``header_rest`` holds its bytes behind the head.
    """

    def head(path: str) -> dict:
        try:
            with open_input(path) as f:
                first, rest = f.read(HEAD_BYTES), b""
                if len(first) == HEAD_BYTES and path.lower().endswith(".csv"):
                    rest = _header_rest(first, f)
                return {"head": first, "header_rest": rest, "read_error": None}
        except Exception as e:  # reported per file, never fails the batch
            return {"head": None, "header_rest": None, "read_error": str(e)}

    return _with_columns(files, "head binary, header_rest binary, read_error string", head)


def _header_rest(head: bytes, file) -> bytes:
    """What follows ``head`` up to the end of the first record: a line end outside quotes behind some text.

    The file is scanned in blocks of which nothing is kept; only then is the rest of a record read. Quotes that
    stay open up to the end of the file make no record: the check for unclosed quotes reports such a file.
    """
    quotes, text, block, passed = 0, False, head, 0
    while block:
        at = 0
        while at < len(block):
            end = block.find(b"\n", at)
            line = block[at:] if end < 0 else block[at:end]
            quotes += line.count(b'"')
            text = text or bool(line.strip())
            if end >= 0 and text and quotes % 2 == 0:
                return _between(file, len(head), passed + end)
            at = len(block) if end < 0 else end + 1
        passed += len(block)
        block = file.read(BLOCK)
    return b"" if quotes % 2 else _between(file, len(head), passed)


def _between(file, start: int, end: int) -> bytes:
    if end <= start:
        return b""
    file.seek(start)
    return file.read(end - start)


def hash_files(files: DataFrame) -> DataFrame:
    """Add the SHA-256 of every file, read in blocks: constant memory per task."""

    def digest(path: str) -> dict:
        try:
            h = hashlib.sha256()
            with open_input(path) as f:
                while block := f.read(BLOCK):
                    h.update(block)
            return {"hash_sha256": h.hexdigest()}
        except Exception:
            return {"hash_sha256": "indisponivel"}

    return _with_columns(files, "hash_sha256 string", digest)
