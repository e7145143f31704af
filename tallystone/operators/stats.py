"""Per-file statistics for data skipping: rows, nulls, min, max, and Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def ordered_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, ORDERED)]


def _least_greatest(x: pa.Array) -> tuple:
    """Least and greatest values in Spark's order, in which NaN is above all others; null for none."""
    if pa.types.is_floating(x.type) and pc.any(nan := pc.is_nan(x)).as_py():
        rest = x.filter(pc.invert(nan))
        return pc.min(rest) if rest.null_count < len(rest) else pa.scalar(math.nan, x.type), pa.scalar(math.nan, x.type)
    found = pc.min_max(x)
    return found["min"], found["max"]


def file_stats(data: DataFrame, columns: list[str]) -> DataFrame:
    """One row per file of ``data``: file, rows, and min_c, max_c, nulls_c of each column.

    Tasks reduce their batches, so no rows are sorted by their files (Spark sorts to aggregate texts), and a task holds one batch.
    """
    kinds = [data.schema[c].dataType for c in columns]
    fields = [T.StructField("file", T.StringType()), T.StructField("rows", T.LongType())]
    for c, k in zip(columns, kinds, strict=True):
        fields += [T.StructField(f"min_{c}", k), T.StructField(f"max_{c}", k), T.StructField(f"nulls_{c}", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = pc.run_end_encode(b.column(0))  # a file's rows follow one another
            start = 0
            for file, end in zip(runs.values, runs.run_ends.to_pylist(), strict=True):
                part = b.slice(start, end - start)
                row = [file, pa.scalar(end - start, pa.int64())]
                for i in range(1, part.num_columns):
                    row += [*_least_greatest(part.column(i)), pa.scalar(part.column(i).null_count, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.repeat(v, 1) for v in row], names=[f.name for f in fields])
                start = end

    made = data.select(F.col("_metadata.file_path").alias("file"), *[F.col(f"`{c}`") for c in columns]).mapInArrow(run, T.StructType(fields))
    totals = [f(f"`{p}{c}`").alias(f"{p}{c}") for c in columns for p, f in (("min_", F.min), ("max_", F.max), ("nulls_", F.sum))]
    return made.groupBy("file").agg(F.sum("rows").alias("rows"), *totals)


def bloom_shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter for n values at a false positive rate."""
    m = max(64, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2))
    return -(-m // 64) * 64, min(16, max(1, round(m / max(1, n) * math.log(2))))


def _position(value: Column, i: Column, m: Column) -> Column:
    text = value.cast("string")
    return F.pmod(F.pmod(F.xxhash64(text), m) + i * (F.pmod(F.xxhash64(text, F.lit(1)), m - 1) + 1), m)


def file_blooms(data: DataFrame, column: str, rate: float = 0.01) -> DataFrame:
    """(file, m, k, words array<long>) per file: distinct values, then bits, combined by OR on the map side."""
    values = data.where(F.col(column).isNotNull()).select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("v")).distinct()
    counts = values.groupBy("file").agg(F.count("*").alias("n"))
    bits = F.ceil(-F.col("n") * math.log(rate) / math.log(2) ** 2 / 64).cast("long") * 64
    shapes = counts.select("file", F.greatest(F.lit(64), bits).cast("long").alias("m"), "n").withColumn("k", F.least(F.lit(16), F.greatest(F.lit(1), F.round(F.col("m") / F.col("n") * math.log(2)))).cast("int"))
    hit = values.join(shapes, "file").select("file", "m", "k", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: _position(F.col("v"), i.cast("long"), F.col("m")))).alias("at"))
    words = hit.groupBy("file", "m", "k", F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
    # all words of a filter, with those that no value sets
    empty = shapes.select("file", "m", "k", F.explode(F.sequence(F.lit(0), (F.col("m") / 64).cast("int") - 1)).alias("w"), F.lit(0).cast("long").alias("bits"))
    filled = words.union(empty).groupBy("file", "m", "k", "w").agg(F.bit_or("bits").alias("bits")).groupBy("file", "m", "k").agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("at"))
    return filled.select("file", "m", "k", F.col("at.bits").alias("words"))


def may_hold(value: Column, m: Column, k: Column, words: Column) -> Column:
    """Whether a Bloom filter may hold a value; true where a file has none."""

    def is_set(i: Column) -> Column:
        at = _position(value, i.cast("long"), m)
        return F.get(words, F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0

    return F.coalesce(F.forall(F.sequence(F.lit(0), k - 1), is_set), F.lit(True))
