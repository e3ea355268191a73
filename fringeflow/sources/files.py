"""Files in whatever store Spark reads: text and bytes by Spark's own readers, writing through Hadoop's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fringeflow.errors import StackIOError
from fringeflow.operators.cube import numbers

#: Pixels of a decoded batch.
BATCH = 1 << 18


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def whole_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark spells it."""
    p, fs = _fs(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str, folders: bool = False) -> list[str]:
    """Names of the files (or folders) in a folder, sorted."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise StackIOError(f"{path}: no such folder")
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders)


def text_of(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise StackIOError(f"{path}: no such file")
    return spark.read.text(path, wholetext=True).first()[0]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        for s in range(0, len(data), 1 << 24):
            out.write(bytearray(data[s : s + (1 << 24)]))
    finally:
        out.close()


@contextmanager
def reader(spark: SparkSession, path: str) -> Iterator[Callable[[int, int], bytes]]:
    """fetch(start, length): bytes of a file, without reading the rest of it."""
    if not exists(spark, path):
        raise StackIOError(f"{path}: no such file")
    p, fs = _fs(spark, path)
    size, stream = fs.getFileStatus(p).getLen(), fs.open(p)

    def fetch(start: int, length: int) -> bytes:
        length = max(0, min(length, size - start))
        if not length:
            return b""
        stream.seek(start)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))

    try:
        yield fetch
    finally:
        stream.close()


def store_uri(spark: SparkSession, path: str) -> str | None:
    """The path as a URI of a store that tasks have a client of their own for; else None."""
    p, fs = _fs(spark, path)
    scheme, _, rest = fs.makeQualified(p).toString().partition(":")
    if scheme not in ("file", "hdfs", "s3", "s3a", "gs"):
        return None
    return f"{'s3' if scheme == 's3a' else scheme}://{rest if rest.startswith('//') else '//' + rest}".replace(":////", "://")


def opened(uri: str) -> tuple[Callable[[int, int], bytes], int]:
    """In a task: fetch(start, length) of a file, and its size."""
    from pyarrow import fs as stores

    store, path = stores.FileSystem.from_uri(uri)
    file = store.open_input_file(path)
    size = file.size()
    return lambda at, n: file.read_at(max(0, min(n, size - at)), at) if at < size else b"", size


def writer(spark: SparkSession, folder: str) -> Callable[[str, bytes], None] | None:
    """put(name, bytes) for tasks to write into a folder of a store that they have a client for; else None.

    A file appears under its name when it is whole, so a task that runs again does no harm.
    """
    uri = store_uri(spark, folder)
    if uri is None:
        return None

    def put(name: str, data: bytes) -> None:
        from pyarrow import fs as stores

        store, path = stores.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{path}/{name}")

    return put


def binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content: a row a file."""
    for p in paths:
        if not exists(spark, p):
            raise StackIOError(f"{p}: no such file")
    try:
        return spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    except AnalysisException as e:
        raise StackIOError(f"{paths[0]}: {e}") from e


def same_file(uri: str) -> str:
    """One spelling for a file's URI."""
    scheme, _, rest = uri.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if scheme == "file" else uri


def pixels_of(spark: SparkSession, paths: list[str], decode: Callable[[str, bytes], list[np.ndarray]], values: list[str], index: str = "layer") -> DataFrame:
    """row, col, index (the file's place in paths), values: what decode(relative path, bytes) makes of each file, row-major."""
    places: dict[str, list[int]] = {}
    for i, p in enumerate(paths):  # a path may be listed more than once
        places.setdefault(same_file(whole_uri(spark, p)), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = places[same_file(path)]
                grids = decode(paths[own[0]], content)
                rows, cols = grids[0].shape
                step = max(1, BATCH // max(1, cols))
                for s, at in ((s, at) for at in own for s in range(0, rows, step)):
                    e = min(rows, s + step)
                    n = (e - s) * cols
                    place = [pa.array(np.repeat(np.arange(s, e), cols), pa.int32()), pa.array(np.tile(np.arange(cols), e - s), pa.int32()), pa.array(np.full(n, at), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*place, *(numbers(np.where(np.isfinite(g[s:e]), g[s:e], np.nan).ravel()) for g in grids)], ["row", "col", index, *values])

    schema = ", ".join(["row int", "col int", f"{index} int", *(f"{v} double" for v in values)])
    return binary(spark, list(places)).mapInArrow(run, schema)
