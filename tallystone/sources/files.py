"""Files that Python workers open by themselves, and how they are dealt to tasks."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are read at once.
STEP = 1 << 20


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI, as Hadoop writes it, or of a plain path; None for other schemes."""
    if m := re.match(r"file:/+", uri):
        return "/" + uri[m.end() :]
    return None if re.match(r"[A-Za-z][\w+.-]+:/", uri) else uri


def can_open(uri: str) -> bool:
    """Whether ``open_binary`` reaches a place: a mounted one, or a store that Arrow has a file system for."""
    if local_path(uri) is not None:
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(uri)
        return True
    except Exception:  # an unknown scheme, or a client library that isn't there
        return False


def open_binary(uri: str) -> BinaryIO:
    """A seekable stream of a file's bytes."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def sha256_of(stream: BinaryIO) -> str:
    """The digest of a stream, which is never held."""
    h, buffer = hashlib.sha256(), bytearray(STEP)
    view = memoryview(buffer)
    while n := stream.readinto(view):
        h.update(view[:n])
    return h.hexdigest()


def dealt(items: Iterable[tuple[Any, int]], bins: int) -> list[list[Any]]:
    """Items in at most so many groups of about the same bytes, the largest first."""
    heap: list[tuple[int, int]] = [(0, i) for i in range(max(1, bins))]
    out: list[list[Any]] = [[] for _ in heap]
    for item, size in sorted(items, key=lambda x: -x[1]):
        total, i = heapq.heappop(heap)
        out[i].append(item)
        heapq.heappush(heap, (total + size + STEP // 16, i))  # opening a file costs as well
    return [x for x in out if x]


def tasks_over(spark: SparkSession, items: Iterable[tuple[str, int]], run: Callable[[str], list[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """Rows that ``run`` makes of each item in tasks that have about the same bytes to read; a task holds the names of its items alone."""
    groups = dealt(items, spark.sparkContext.defaultParallelism)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names in b.column(0).to_pylist():
                for name in names:
                    rows = run(name)
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f.strip().split()[0] for f in schema.split(",")])

    if not groups:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(g,) for g in groups], "names array<string>").mapInArrow(go, schema)  # a row, and so a task, each
