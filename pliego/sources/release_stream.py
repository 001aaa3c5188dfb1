"""Releases of whole-document packages, read as a stream (SC-2, SC-3).

A package may be one document of any size, alone or as the first member of a
zip archive.  ``ReleasePackages`` is a Spark data source that hands each release
on while the document is still being read: a task holds one chunk of text and
one release, whatever the document's size.  Documents may be compressed (gzip).
Files are dealt to partitions by size; the releases are parsed by Spark with the
declared schema.
"""
from __future__ import annotations

import codecs
import heapq
import json
import math
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import data_files, filesystem, qualified
from .schema import release_type

#: Characters read at a time, and releases or characters that leave a task in one batch.
CHUNK = 1 << 16
ROWS, CHARACTERS = 500, 1 << 20
#: Bytes of files that one task reads, if they are many small ones.
TASK_BYTES = 64 << 20
#: Releases are dealt out by files, if none has more than so many times a task's share of the bytes.
UNEVEN = 2
#: How near to the end of what is read an error may be the end's fault.
CUT = 16

_AFTER = ",:]} \t\r\n"


class _Text:
    """Text that is read in chunks; only what has not been passed yet is held."""

    def __init__(self, read: Callable[[int], str]):
        self.read, self.held, self.at = read, "", 0
        self.decode = json.JSONDecoder().raw_decode

    def more(self) -> bool:
        piece = self.read(max(CHUNK, len(self.held) - self.at))  # doubles while one value goes on
        self.held, self.at = self.held[self.at:] + piece, 0
        return bool(piece)

    def next(self) -> str:
        """The next character that is not white space, '' at the end."""
        while True:
            while self.at < len(self.held):
                if self.held[self.at] not in " \t\r\n﻿":
                    return self.held[self.at]
                self.at += 1
            if not self.more():
                return ""

    def take(self, *wanted: str) -> str:
        c = self.next()
        if c not in wanted or not c:
            raise ValueError(f"{' or '.join(wanted)} expected, {c or 'the end'} found")
        self.at += 1
        return c

    def value(self) -> str:
        """The text of the JSON value that begins here."""
        self.next()
        while True:
            try:
                _, end = self.decode(self.held, self.at)
            except json.JSONDecodeError as e:
                cut = e.pos >= len(self.held) - CUT or e.msg.startswith("Unterminated string")
                if not cut or not self.more():
                    raise
                continue
            ended = end < len(self.held) and self.held[end] in _AFTER
            if not ended and end >= len(self.held) - CUT and self.more():
                continue  # a number may go on
            text = self.held[self.at:end]
            self.at = end
            return text


def _elements(text: _Text) -> Iterator[str]:
    text.take("[")
    if text.next() == "]":
        text.at += 1
        return
    while True:
        yield text.value()
        if text.take(",", "]") == "]":
            return


def release_texts(read: Callable[[int], str], field: str = "releases") -> Iterator[str]:
    """JSON texts of the elements of a document's array ``field``, as they are written.

    A document without the field, or with null there, has none.  Other fields
    are passed over, arrays among them element by element.
    """
    text = _Text(read)
    text.take("{")
    if text.next() == "}":
        return
    while True:
        name = json.loads(text.value())
        if not isinstance(name, str):
            raise ValueError("a field's name expected")
        text.take(":")
        if text.next() == "[":
            for value in _elements(text):
                if name == field:
                    yield value
        else:
            value = text.value()
            if name == field and value != "null":
                raise ValueError(f"{field} is no array")
        if text.take(",", "}") == "}":
            return


def decoded(stream) -> Callable[[int], str]:
    """``read`` of a binary stream as UTF-8 text."""
    decoder = codecs.getincrementaldecoder("utf-8")()

    def read(n: int) -> str:
        while True:
            data = stream.read(n)
            text = decoder.decode(data, final=not data)
            if text or not data:
                return text
    return read


def _even(sizes: list[int], tasks: int) -> bool:
    """Whether ``tasks`` tasks can share files of these sizes."""
    return len(sizes) >= tasks and max(sizes) * tasks <= UNEVEN * sum(sizes)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _package_files(path: str, layout: str) -> list[tuple[str, int]]:
    return data_files(path, ".zip" if layout == "zip" else "")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.layout = options.get("layout", "document")
        self.tasks = int(options.get("tasks", 0))
        if self.layout not in ("document", "zip"):
            raise ValueError(f"unknown layout {self.layout!r}")

    def partitions(self) -> list[InputPartition]:
        files = _package_files(self.path, self.layout)
        if self.tasks and _even([size for _, size in files], self.tasks):
            n = max(self.tasks, math.ceil(sum(size for _, size in files) / TASK_BYTES))
            least = [(0, k, []) for k in range(n)]
            for path, size in sorted(files, key=lambda f: -f[1]):
                bytes_, k, paths = least[0]
                heapq.heapreplace(least, (bytes_ + size, k, [*paths, path]))
            return [_Files(paths) for _, _, paths in least if paths]
        parts, bytes_ = [[]], 0
        for path, size in files:
            if parts[-1] and bytes_ + size > TASK_BYTES:
                parts.append([])
                bytes_ = 0
            parts[-1].append(path)
            bytes_ += size
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        for path in partition.paths:
            rows: list[str] = []
            size = 0
            try:
                for text in self._releases(store, path):
                    rows.append(text)
                    size += len(text)
                    if len(rows) >= ROWS or size >= CHARACTERS:
                        yield self._batch(path, rows)
                        rows, size = [], 0
            except (zipfile.BadZipFile, OSError, ValueError, RecursionError) as e:
                raise ValueError(f"{path}: no release package: {e!r}") from e
            if rows:
                yield self._batch(path, rows)

    def _releases(self, store, path: str) -> Iterator[str]:
        if self.layout == "document":
            with store.open_input_stream(path) as f:  # undoes the compression that the name tells
                yield from release_texts(decoded(f))
            return
        with store.open_input_file(path) as f:
            with zipfile.ZipFile(f) as z:
                if not z.namelist():
                    raise ValueError("an archive without members")
                with z.open(z.namelist()[0]) as member:
                    yield from release_texts(decoded(member))

    @staticmethod
    def _batch(path: str, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(rows, pa.string())],
                                          names=["path", "release"])


class ReleasePackages(DataSource):
    """Spark format ``release_packages``: ``path``, ``release`` (JSON text); options ``layout``: document or zip,
    ``tasks``: how many partitions share the files, if they are many and even."""

    @classmethod
    def name(cls) -> str:
        return "release_packages"

    def schema(self) -> str:
        return "path string, release string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_release_texts(spark: SparkSession, path: str, layout: str = "document", tasks: int = 0) -> DataFrame:
    """``path``, ``release`` (JSON text) of each release of the packages at or under ``path``.

    A file that is no package is an error that names it.
    """
    spark.dataSource.register(ReleasePackages)
    return spark.read.format("release_packages").option("layout", layout).option("tasks", tasks).load(qualified(spark, path))


def read_release_stream(spark: SparkSession, path: str, layout: str = "document",
                        partitions: int | None = None) -> DataFrame:
    """SC-2 / SC-3 + PR-1: one row per release of whole documents or of archives' first members.

    ``partitions`` spreads the releases before they are parsed: by the files that a task
    reads, or release by release for few large files.
    """
    texts = read_release_texts(spark, path, layout, partitions or 0).select("release")
    if partitions and not _even([size for _, size in _package_files(qualified(spark, path), layout)], partitions):
        texts = texts.repartition(partitions)
    return texts.select(F.from_json("release", release_type()).alias("r")).select("r.*")
