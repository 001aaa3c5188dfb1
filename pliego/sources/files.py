"""Files that Python tasks open themselves: one rule for what a path means.

A path without a scheme belongs to Spark's default file system, as it does for
Spark's own readers and writers; ``qualified`` says so before the path leaves
the driver, so that no task takes it for a file of its own machine.
"""
from __future__ import annotations

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would give it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def filesystem(path: str):
    """pyarrow file system and path of a location: ``file:/…``, ``file:///…`` or any URI pyarrow knows (hdfs://, s3://)."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def data_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path within the file system, bytes) of the files at or under ``path``; names that begin with _ or . are left out, as Spark does."""
    from pyarrow import fs
    store, base = filesystem(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)
                  and not any(p[:1] in "_." for p in f.path[len(base.rstrip("/")) + 1:].split("/")))
