"""Bytes of large files without holding a file: the first few, or a digest taken block by block.

Spark lists the paths (their contents are pruned from the scan) and deals them to tasks; each task opens its files by
``pyarrow.fs``, so a scheme that it does not know (local paths, file, hdfs, s3, gs are) falls back to Spark's own reader,
which holds one file at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")
BLOCK = 1 << 22
HEAD = 40


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, root`` of all files below ``root``; Spark does not list files of no byte."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.lit(root).alias("root"))


def _reader(path: str) -> pa.NativeFile:
    scheme, _, rest = path.partition(":")
    if not rest:
        return fs.LocalFileSystem().open_input_stream(path, compression=None)
    if scheme == "file":  # Hadoop writes file:/path
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_stream(inner, compression=None)


def _each(files: DataFrame, name: str, kind: str, compute: Callable[[str], object]) -> DataFrame:
    """``files`` with one value a file; paths are dealt to tasks by hash, so large files of one folder spread."""
    arrow = {"string": pa.string(), "binary": pa.binary()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [compute(path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + f", {name} {kind}"
    return files.repartition("path").mapInArrow(run, schema)


def _known(path: str = "path") -> Column:
    scheme = F.regexp_extract(path, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return (scheme == "") | scheme.isin(*SCHEMES)


def _by_spark(files: DataFrame, name: str, value: Column) -> DataFrame | None:
    """The same through Spark's reader, for schemes that only it opens: ``files`` then carry their ``root``."""
    rest = files.filter(~_known())
    roots = [] if "root" not in files.columns else [r[0] for r in rest.select("root").distinct().collect()]  # folders that were listed
    if not roots:
        return None
    content = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", value.alias(name))
    return rest.join(content, "path")


def heads(files: DataFrame, size: int = HEAD) -> DataFrame:
    """``files`` (``path``) with ``content``: the first ``size`` bytes of each, and no more of it is read."""
    def head(path: str) -> bytes:
        with _reader(path) as file:
            return file.read(size)

    found = _each(files.filter(_known()), "content", "binary", head)
    rest = _by_spark(files, "content", F.substring("content", 1, size))
    return found if rest is None else found.unionByName(rest)


def digests(files: DataFrame) -> DataFrame:
    """``files`` (``path``) with ``sha256``, read in blocks: a file may be larger than a row or a task's memory."""
    def digest(path: str) -> str:
        found = hashlib.sha256()
        with _reader(path) as file:
            while block := file.read(BLOCK):
                found.update(block)
        return found.hexdigest()

    found = _each(files.filter(_known()), "sha256", "string", digest)
    rest = _by_spark(files, "sha256", F.sha2("content", 256))
    return found if rest is None else found.unionByName(rest)
