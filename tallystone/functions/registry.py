"""Kinds of file indexes by name: how to build one from data, and how to ask it.

A table builds the kinds that its columns declare for the files of each commit, and asks them before it
reads: a file stays out where a kind says that no row can match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import stats


@dataclass(frozen=True)
class IndexKind:
    """``build(data, column, **options)`` gives a row per file, with ``file``; ``may_match(op, value)`` a filter over those
    rows, for the ops ``= != < <= > >= contains``: true wherever the file may hold a match, and for ops it doesn't know."""

    build: Callable[..., DataFrame]
    may_match: Callable[[str, Column], Column]


_KINDS: dict[str, IndexKind] = {}


def register(name: str, kind: IndexKind) -> None:
    _KINDS[name] = kind


def get(name: str) -> IndexKind:
    if name not in _KINDS:
        raise KeyError(f"no index kind {name!r}; known: {sorted(_KINDS)}")
    return _KINDS[name]


def known(name: str) -> bool:
    return name in _KINDS


def _minmax(data: DataFrame, column: str) -> DataFrame:
    one = stats.file_stats(data, [column])
    return one.select("file", "rows", F.col(f"min_{column}").alias("min"), F.col(f"max_{column}").alias("max"))


def _between(op: str, value: Column) -> Column:
    tests = {"=": (F.col("min") <= value) & (F.col("max") >= value), "<": F.col("min") < value, "<=": F.col("min") <= value, ">": F.col("max") > value, ">=": F.col("max") >= value}
    return F.coalesce(tests.get(op, F.lit(True)), F.lit(False))


def _bloom(op: str, value: Column) -> Column:
    return stats.may_hold(value, F.col("m"), F.col("k"), F.col("words")) if op == "=" else F.lit(True)


register("minmax", IndexKind(_minmax, _between))
register("bloom", IndexKind(stats.file_blooms, _bloom))


def _grams(text: Column) -> Column:
    """All runs of three characters of a short text."""
    return F.when(F.length(text) > 2, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: text.substr(i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


#: Characters that a task looks at together.
MANY_CHARACTERS = 1 << 20


def _pieces(texts: Iterator[bytes | None]) -> Iterator[list[str]]:
    """Texts in lists of at most ``MANY_CHARACTERS``, longer ones in pieces that share two characters."""
    out, size = [], 0
    for t in texts:
        t = (t or b"").decode("utf-8", "replace")
        for i in range(0, max(1, len(t) - 2), MANY_CHARACTERS):
            piece = t[i : i + MANY_CHARACTERS + 2]
            if out and size + len(piece) > MANY_CHARACTERS:
                yield out
                out, size = [], 0
            out.append(piece)
            size += len(piece)
    if out:
        yield out


def distinct_grams(texts: Iterator[bytes | None]) -> Iterator[list[str]]:
    """The runs of three characters of UTF-8 texts, in lists of different ones; few come again in a later list."""
    seen = np.full(1 << 18, -1, np.int64)  # the last one of each slot
    for piece in _pieces(texts):
        points = np.frombuffer("".join(piece).encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(points) < 3:
            continue
        keys = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
        inside = np.ones(len(points), bool)
        ends = np.cumsum([len(t) for t in piece])
        for back in (1, 2):  # a run that starts at one of a text's last two characters leaves it
            inside[(ends - back)[ends >= back]] = False
        keys = keys[inside[:-2]]
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
        new = keys[seen[slots] != keys]
        if len(new):
            new = np.unique(new)
            seen[(new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)] = new
            text = np.stack([new >> 42, new >> 21 & 0x1FFFFF, new & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
            yield [text[i : i + 3] for i in range(0, len(text), 3)]


def _file_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, gram): the runs of three characters of each file's rows, and null once."""
    for b in batches:
        runs = pc.run_end_encode(b.column(0))  # a file's rows follow one another
        start = 0
        for file, end in zip(runs.values, runs.run_ends.to_pylist(), strict=True):
            for grams in ([None], *distinct_grams(x.as_py() for x in b.column(1).slice(start, end - start))):
                yield pa.RecordBatch.from_arrays([pa.repeat(file, len(grams)), pa.array(grams, pa.string())], names=["file", "gram"])
            start = end


def _trigram_bits(data: DataFrame, column: str, bits: int = 65_536) -> DataFrame:
    """(file, bits, words map<int, long>) per file: a bitmap of its trigrams' hashes, combined by OR on the map side; no bits where all texts are shorter.

    Tasks find the different trigrams of their rows, so that no row a character is made.
    """
    bits = max(64, -(-int(bits) // 64) * 64)
    grams = data.select(F.col("_metadata.file_path").alias("file"), F.col(column).cast("string").cast("binary").alias("text")).mapInArrow(_file_grams, "file string, gram string")
    at = grams.select("file", F.when(F.col("gram").isNotNull(), F.pmod(F.xxhash64("gram"), F.lit(bits))).alias("at"))
    words = at.groupBy("file", F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("set"))
    return words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "set")))).alias("words")).select("file", F.lit(bits).alias("bits"), "words")


def _holds_trigrams(op: str, value: Column) -> Column:
    if op not in ("=", "contains"):
        return F.lit(True)

    def is_set(g: Column) -> Column:
        at = F.pmod(F.xxhash64(g), F.col("bits"))
        word = F.coalesce(F.try_element_at("words", F.floor(at / 64).cast("int")), F.lit(0))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0

    return F.forall(_grams(value.cast("string")), is_set)


register("trigrams", IndexKind(_trigram_bits, _holds_trigrams))
