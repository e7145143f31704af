"""Exact top-k vector search, filtered before it is ranked: in DataFrame functions for one query, by blocks of rows and queries for many."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import predicate as P

if TYPE_CHECKING:
    from ..sources.table import Table

TINY = 1e-12
#: Queries of a group, rows of a block, and rows scored at once.
QUERIES, BLOCK, STEP = 512, 65_536, 2048


def _array(q: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def score(column: Column, q: list[float] | Column, metric: str) -> Column:
    """cosine; euclidean (minus the distance); l2 (minus its square)."""
    v = q if isinstance(q, Column) else _array(q)
    if metric == "cosine":
        length = norm(q) if isinstance(q, Column) else sum(float(x) ** 2 for x in q) ** 0.5
        return dot(column, v) / (norm(column) * (length + TINY) + TINY)
    square = F.aggregate(F.zip_with(column, v, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "euclidean":
        return F.lit(0.0) - F.sqrt(square)
    if metric == "l2":
        return F.lit(0.0) - square
    raise ValueError(f"unknown metric: {metric}")


def filtered(df: DataFrame, where: str | dict[str, Any] | None) -> DataFrame:
    """A predicate's text, or {column: value or list of values}, all of which must hold. Unknown columns raise."""
    if isinstance(where, dict):
        for c, v in where.items():
            if c not in df.columns:
                raise ValueError(f"unknown column: {c}")
            df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
        return df
    return df.where(P.condition(P.parse(where), df.schema)) if where else df


def search(df: DataFrame, column: str, query: list[float] | None = None, k: int = 5, metric: str = "cosine", where: str | dict[str, Any] | None = None, id_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The k rows of highest score (``__score``), ties by id: a filter, then one take-ordered.

    ``query`` None takes the vector of the smallest id. Vectors of another length than the query's
    raise; null vectors take no part; k below 1 counts as 1.
    """
    key = id_col or ("id" if "id" in df.columns else df.columns[0])
    rows = filtered(df, where).where(F.col(column).isNotNull())
    if query is None:
        first = df.where(F.col(column).isNotNull()).orderBy(key).select(column).first()
        if first is None:
            return rows.select(key, F.lit(0.0).alias("__score")).limit(0)
        query = list(first[0])
    if not query:
        raise ValueError("the query vector is empty")
    right = F.when(F.size(column) == len(query), F.col(column)).otherwise(F.raise_error(F.lit(f"dimension mismatch: {column} against {len(query)}")).cast(df.schema[column].dataType))
    out = rows.withColumn("__score", score(right, query, metric)).orderBy(F.desc("__score"), key).limit(max(1, k))
    return out.select(*(columns or [key]), "__score")


def search_many(df: DataFrame, queries: DataFrame, column: str, key: str, k: int = 5, metric: str = "cosine", where: str | dict[str, Any] | None = None) -> DataFrame:
    """(query_id, key, __score): for each row of ``queries`` the k rows of highest score, ties by id.

    Queries are dealt into groups of bounded size and rows into blocks of bounded size; a task takes a group and a
    block at a time, as two matrices, and keeps its k best a query. Null vectors take no part, and
    vectors of another length than a query's raise.
    """
    k = max(1, k)
    kind, query_kind = df.schema[key].dataType.simpleString(), queries.schema[key].dataType.simpleString()
    rows = filtered(df, where).where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
    asks = queries.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
    n_groups, n_blocks = max(1, -(-asks.count() // QUERIES)), max(1, -(-rows.count() // BLOCK))

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    none, no_query = F.lit(None).cast(kind), F.lit(None).cast(query_kind)
    left = asks.select(part(n_groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.lit(0).alias("role"), F.col("id").alias("query_id"), none.alias("id"), "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("g"), part(n_blocks).alias("b"), F.lit(1).alias("role"), no_query.alias("query_id"), "id", "v")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, queries_of = None, [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(3)])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *change], [*change, b.num_rows], strict=True):
                if z == a:
                    continue
                if tuple(keys[:2, a]) != group:
                    group, held, queries_of = tuple(keys[:2, a]), [], None
                rows_here = b.slice(a, z - a)
                if keys[2, a] == 0:
                    held.append(rows_here)
                    continue
                if held:
                    of = pa.Table.from_batches(held).combine_chunks()
                    queries_of, held = (of.column(3).combine_chunks(), _matrix(of.column(5).combine_chunks(), column)), []
                if queries_of is None:
                    continue
                ids, q = queries_of
                for at in range(0, rows_here.num_rows, STEP):
                    few = rows_here.slice(at, STEP)
                    m = _matrix(few.column(5), column)
                    if m.shape[1] != q.shape[1]:
                        raise ValueError(f"dimension mismatch: {column} has {m.shape[1]} against {q.shape[1]}")
                    s = _scores(q, m, metric)
                    if k < s.shape[1]:  # rows that tie with the k-th stay, the window decides by id
                        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                        i, j = np.nonzero(s >= least[:, None])
                    else:
                        i, j = (x.ravel() for x in np.indices(s.shape))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), few.column(4).take(pa.array(j)), pa.array(s[i, j])], names=["query_id", key, "__score"])

    found = left.union(right).repartition("g", "b").sortWithinPartitions("g", "b", "role").mapInArrow(scored, f"query_id {query_kind}, `{key}` {kind}, __score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("__score"), key)
    return found.withColumn("__place", F.row_number().over(best)).where(F.col("__place") <= k).drop("__place")


def _matrix(column: pa.Array, name: str) -> np.ndarray:
    """Rows of a list array, all of one length."""
    sizes = np.diff(np.asarray(column.offsets).astype(np.int64))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"dimension mismatch: {name} has {sizes.min()} to {sizes.max()}")
    return np.asarray(column.flatten().fill_null(np.nan)).reshape(len(sizes), int(sizes[0]) if len(sizes) else 0)


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """What ``score`` gives for each row of one matrix with each of the other."""
    if metric == "cosine":
        return (q @ m.T) / (np.sqrt((m * m).sum(axis=1))[None, :] * (np.sqrt((q * q).sum(axis=1))[:, None] + TINY) + TINY)
    square = np.stack([((m - x) ** 2).sum(axis=1) for x in q])  # by differences, as expanded squares lose digits
    if metric == "euclidean":
        return 0.0 - np.sqrt(square)
    if metric == "l2":
        return 0.0 - square
    raise ValueError(f"unknown metric: {metric}")


def build_index(table: Table, column: str = "embedding", dim: int | None = None, id_col: str | None = None, metric: str = "cosine") -> dict[str, Any]:
    """Store (id, vector, norm) of the table's current rows, so that searches needn't read the rest; vectors of another length than ``dim`` raise."""
    manifest = table.manifest()
    df = table._scan(manifest)
    key = id_col or ("id" if "id" in df.columns else df.columns[0])
    rows = df.where(F.col(column).isNotNull())
    low, high, n = rows.agg(F.min(F.size(column)), F.max(F.size(column)), F.count("*")).first()
    if n and (low != high or (dim is not None and dim != low)):
        raise ValueError(f"dimension mismatch: {column} has lengths {low} to {high}, wanted {dim or 'one'}")
    name = f"meta/vector/{column}-{manifest['generation']:06d}"
    rows.select(key, column, norm(F.col(column)).alias("norm")).write.mode("overwrite").option("compression", "zstd").parquet(f"{table.path}/{name}")
    table.store.write_json(f"meta/vector/{column}.json", {"version": 1, "algo": "flat", "column": column, "id": key, "metric": metric, "dim": low, "vectors_path": name, "vectors_n": n, "generation": manifest["generation"]})
    return {"ok": True, "index_path": name}


def search_table(table: Table, query: list[float] | None = None, k: int = 10, column: str = "embedding", metric: str | None = None, where: str | dict[str, Any] | None = None, columns: list[str] | None = None, as_of: str | None = None) -> DataFrame:
    """Search a table as of a time. The stored index serves searches of the generation it was built on that need no other column."""
    meta = table.store.read_json(f"meta/vector/{column}.json")
    current = table.manifest_as_of(as_of)["generation"]
    key = meta["id"] if meta else None
    if meta and meta["generation"] == current and not where and not columns:
        return search(table.spark.read.parquet(f"{table.path}/{meta['vectors_path']}"), column, query, k, metric or meta["metric"], None, key)
    return search(table.read(as_of=as_of), column, query, k, metric or (meta or {}).get("metric", "cosine"), where, key, columns)
