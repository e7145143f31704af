"""Exact top-k search by inner product over integer vectors.

Vectors are held in blocks of similar length, longest first. A query meets a block only
where its length times the block's greatest reaches the score it already has k times. In
a block, vectors come by descending length in batches; the components rotated by the
singular vectors of the whole table are summed over the leading directions, and the
Cauchy-Schwarz bound of the residuals decides which pairs are scored exactly, on the
integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, range_cuts, range_part, staged

#: Candidates of a block, queries of a block, and seed vectors (the longest) that give first thresholds.
BLOCK, QUERIES, SEEDS = 16384, 1024, 1024
#: Candidates scored at once, and the leading rotated components.
STEP, LEAD = 2048, 16


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, v, norm) and the columns ``keep``: floor(scale * x) of each component, as doubles, which hold these integers exactly.

    Rows go that have no id, or whose vector is null or holds a part that is null, or not finite
    (also after scaling, from 2**1016 on). Components may be as large as doubles are.
    """
    x = F.col(vector_col)
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a.cast("double") * scale) < F.lit(math.inf)))
    # Spark's floor gives a long; from 2**52 on a double has no fraction to cut off
    v = F.transform("scaled", lambda a: F.when(F.abs(a) < float(1 << 52), F.floor(a).cast("double")).otherwise(a))
    out = table.where(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    out = out.select(F.col(id_col).cast("long").alias("vec_id"), *keep, F.transform(x, lambda a: a.cast("double") * scale).alias("scaled")).select("vec_id", *keep, v.alias("v"))
    top = F.greatest(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("top", top).select("vec_id", *keep, "v", (F.col("top") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + (a / F.col("top")) * (a / F.col("top"))))).alias("norm"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array as float64 (exact for the integers used), zeros after a shorter vector's end."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.float64)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the whole table, strongest first, from its Gram matrix (dim * dim sums)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim)
            norm = np.abs(m).max(axis=1, initial=0.0)
            m[norm >= LONG] /= norm[norm >= LONG, None]  # a few huge ones would leave no digits for the rest
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["line", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for line, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[line] = sums.get(line, 0.0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], names=["line", "sums"])

    kind, out = "line int, sums binary", np.zeros((dim, dim))
    for r in vectors.select("v").mapInArrow(gram, kind).repartition("line").mapInArrow(added, kind).collect():
        out[r.line] = np.frombuffer(r.sums)
    return np.linalg.eigh(out)[1][:, ::-1].copy()


#: Products of norms below which every partial sum is an exact integer: of float64 products, of int64 ones. Norms that count as huge.
EXACT, FITS, LONG = float(1 << 52), float(1 << 62), float(1 << 31)


def _whole(x: np.ndarray) -> np.ndarray:
    """The same matrix of Python's integers."""
    return np.asarray([[int(c) for c in row] for row in x], object).reshape(x.shape)


def _products(a: np.ndarray, b: np.ndarray, a_norm: np.ndarray, b_norm: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices: int64, or Python's integers where one may not fit it."""
    with np.errstate(over="ignore", invalid="ignore"):
        rows = np.flatnonzero(~(a_norm * b_norm.max(initial=0.0) < EXACT))
        columns = np.flatnonzero(~(b_norm * a_norm.max(initial=0.0) < EXACT))
        out = np.nan_to_num(a @ b.T, posinf=0.0, neginf=0.0)
        largest = a_norm.max(initial=0.0) * b_norm.max(initial=0.0)
    if not len(rows):
        return out.astype(np.int64)
    hard = np.ix_(rows, columns)
    if largest < FITS:
        out = out.astype(np.int64)
        out[hard] = a[rows].astype(np.int64) @ b[columns].astype(np.int64).T
        return out
    out[hard] = 0
    out = out.astype(np.int64).astype(object)
    out[hard] = _whole(a[rows]) @ _whole(b[columns]).T
    return out


def _pair_products(a: np.ndarray, b: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The same of each row of one with its row of the other; ``norms`` are the products of their norms."""
    hard = np.flatnonzero(~(norms < EXACT))
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("ij,ij->i", a, b)
    out[hard] = 0
    out = out.astype(np.int64)
    if len(hard) and (norms < FITS).all():
        out[hard] = np.einsum("ij,ij->i", a[hard].astype(np.int64), b[hard].astype(np.int64))
    elif len(hard):
        out = out.astype(object)
        out[hard] = (_whole(a[hard]) * _whole(b[hard])).sum(axis=1)
    return out


def _as_long(score: np.ndarray) -> np.ndarray:
    """Scores at the ends of int64 where they are beyond them."""
    return score if score.dtype == np.int64 else np.asarray([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score], np.int64)


def _as_float(score: np.ndarray) -> np.ndarray:
    return score.astype(np.float64) if score.dtype == np.int64 else np.asarray([float(min(max(x, -(10**308)), 10**308)) for x in score])


def _beyond(score: np.ndarray) -> list[bytes]:
    """Bytes in the order of the scores that ``_as_long`` makes equal; one byte for all that fit."""
    if score.dtype == np.int64:
        return [b"\x01"] * len(score)
    out = []
    for x in score:
        size = (abs(x).bit_length() + 7) // 8
        raw = size.to_bytes(2, "big") + abs(x).to_bytes(size, "big")
        out.append(b"\x01" if -(1 << 63) <= x < 1 << 63 else b"\x02" + raw if x > 0 else b"\x00" + bytes(255 - c for c in raw))
    return out


_NONE = np.iinfo(np.int64).min


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best pairs: by score descending, then id."""
    if score.dtype == np.int64:
        order = np.lexsort((ids, -score, q))
    else:
        order = np.asarray(sorted(range(len(q)), key=lambda i: (q[i], -score[i], ids[i])), np.int64)
    new = np.ones(len(order), bool)
    new[1:] = q[order][1:] != q[order][:-1]
    first = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query row with rows of other ids.

    ``vectors`` are (vec_id, v array<double>, norm) as of ``integer_vectors``; ``queries`` says which
    rows ask. Ties go to the smaller vec_id; with fewer than k rows all are returned. Repeated rows
    each count as candidates; of several query rows with one id the smallest vector asks. Shorter
    vectors count as zero beyond their end, empty ones as zero. Empty tables give no rows. Scores are
    compared exactly at any size (in float64 or int64 where those are exact, else in Python's
    integers); one beyond a long is given as the nearest long. The driver holds dim * dim sums.
    """
    spark = vectors.sparkSession
    data, path = staged(vectors.select("vec_id", F.col("v").cast("array<double>").alias("v"), "norm"), "vectors")
    size = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not size.n:
        drop_path(spark, path)
        return spark.createDataFrame([], result)
    dim = max(1, size.dim)
    lead = min(LEAD, dim)
    turn = spark.sparkContext.broadcast(rotation(data, dim))

    # blocks of similar length; equal lengths are dealt by id
    n_bands = max(1, min(256, size.n // BLOCK))
    bounds = sorted(set(data.approxQuantile("norm", [i / n_bands for i in range(1, n_bands)], 0.2 / n_bands))) if n_bands > 1 else []
    band = F.size(F.filter(F.array(*[F.lit(c) for c in bounds]).cast("array<double>"), lambda c: c < F.col("norm"))) if bounds else F.lit(0)
    data = data.withColumn("band", band.cast("int"))
    blocks = data.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.max("norm").alias("longest"))

    # first thresholds: the k-th best among the longest vectors
    seeds = data.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v", "norm").toPandas()
    seed_ids, seed_v = seeds["vec_id"].to_numpy(), np.zeros((len(seeds), dim))
    for i, v in enumerate(seeds["v"]):
        seed_v[i, : len(v)] = v
    held = spark.sparkContext.broadcast((seed_ids, seed_v, seeds["norm"].to_numpy(np.float64)))

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m, lengths = held.value
        for b in batches:
            mine, norm = np.asarray(b.column(0)), np.asarray(b.column(2))
            least, at = np.full(len(mine), _NONE), np.full(len(mine), np.iinfo(np.int64).max)
            for i in range(0, len(mine), STEP):
                s = _products(_matrix(b.column(1).slice(i, STEP), dim), m, norm[i : i + STEP], lengths)
                own = mine[i : i + STEP, None] == ids[None, :]
                q, c = np.nonzero(~own)
                take = _best(q, s[q, c], ids[c], k)
                got = np.bincount(q[take], minlength=len(s))
                last = np.cumsum(got) - 1
                full = np.flatnonzero(got == k)
                kth = s[q, c][take][last[full]]
                least[i + full] = _as_long(kth)
                at[i + full] = np.where(_as_long(kth) == kth, ids[c][take][last[full]], at[i + full])  # a clipped bound lets all ids through
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least), pa.array(at)], names=["vec_id", "v", "norm", "least", "least_id"])

    asks = data.where(queries).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("ask"))
    asks, asks_path = staged(asks.select("vec_id", "ask.v", "ask.norm").mapInArrow(first_bounds, "vec_id long, v array<double>, norm double, least long, least_id long"), "queries")
    n_asks = asks.count()
    reach = F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-6
    zero = F.lit(0.0)
    # queries that need similar lengths go together, so that a block of short vectors meets few of their groups
    asks = asks.withColumn("needs", F.when(F.col("norm") > 0, F.col("least") / F.col("norm")).otherwise(F.lit(-1e300)))
    cuts = range_cuts(asks, "needs", max(1, math.ceil(n_asks / QUERIES)), every=True)
    asks = asks.withColumn("range", range_part(F.col("needs"), cuts, "double"))
    first, per_range = 0, []
    for r in sorted(asks.groupBy("range").count().collect()):  # at most 16,384 rows
        per_range.append((r["range"], first, math.ceil(r["count"] / QUERIES)))
        first += per_range[-1][2]
    ranges = spark.createDataFrame(per_range, "range int, first int, groups int")
    asks = asks.join(F.broadcast(ranges), "range").withColumn("g", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
    met = asks.join(F.broadcast(blocks), reach >= F.col("least"))  # at most 256 rows
    reached, reached_path = staged(met.groupBy("band").agg(F.max("g").alias("last")).join(blocks, "band").select("band", "last", "parts"), "reached")
    met = met.select("g", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), zero.alias("order"), "vec_id", "v", "norm", "least", "least_id")
    cands = data.join(F.broadcast(reached), "band").select(
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("g"), "band", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), (-F.col("norm")).alias("order"), "vec_id", "v", "norm", F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("least_id")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot, group, state = turn.value, None, None

        def found(state):
            if state is None or not len(state["q"]):
                return None
            return [state["ids"][state["q"]], state["c"], _as_long(state["s"]), _beyond(state["s"])]

        for b in batches:
            keys = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(4)])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            out = []
            for a, z in zip([0, *change], [*change, b.num_rows], strict=True):
                key, role = tuple(keys[:3, a]), keys[3, a]
                if key != group:
                    out.append(found(state))
                    group, state = key, None
                ids, m, norm = np.asarray(b.column(5))[a:z], _matrix(b.column(6).slice(a, z - a), dim), np.asarray(b.column(7))[a:z]
                if role == 0:
                    new = {"ids": ids, "m": m, "norm": norm, "least": np.asarray(b.column(8))[a:z].copy(), "least_id": np.asarray(b.column(9))[a:z].copy()}
                    if state is not None:  # the queries went on into another batch
                        new = {x: np.concatenate((state[x], y)) for x, y in new.items()}
                    turned = new["m"] @ rot
                    state = new | {"turned": turned, "tail": np.sqrt((turned[:, lead:] ** 2).sum(axis=1)), "q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "s": np.zeros(0, np.int64)}
                elif state is not None:
                    for i in range(0, z - a, STEP):
                        if not _step(state, ids[i : i + STEP], m[i : i + STEP], norm[i : i + STEP], rot):
                            break
            yield from _rows(out)
        yield from _rows([found(state)])

    def _rows(out):
        for x in out:
            if x is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(x, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["query_id", "vec_id", "score", "beyond"])

    def _step(s, ids, m, norm, rot) -> bool:
        """Score the batch's vectors that can still count; False if no query can reach these lengths."""
        least = _as_float(s["least"])
        live = np.flatnonzero(~(s["norm"] * norm.max() * (1 + 1e-9) + 1e-6 < least))
        if not len(live):
            return False
        turned = m @ rot
        tail = np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
        bound = s["turned"][live, :lead] @ turned[:, :lead].T + np.outer(s["tail"][live], tail)
        slack = 1e-6 + 1e-9 * np.outer(s["norm"][live], norm)
        q, c = np.nonzero(~(bound + slack < least[live, None]) & (s["ids"][live, None] != ids[None, :]))
        q = live[q]
        if len(q) * 4 > len(live) * len(ids):
            score = _products(s["m"][live], m, s["norm"][live], norm)[np.searchsorted(live, q), c]
        else:
            score = _pair_products(s["m"][q], m[c], s["norm"][q] * norm[c])
        if score.dtype != s["least"].dtype:
            score, s["least"], s["s"] = score.astype(object), s["least"].astype(object), s["s"].astype(object)
        good = (score > s["least"][q]) | ((score == s["least"][q]) & (ids[c] <= s["least_id"][q]))
        q, c, score = np.concatenate((s["q"], q[good])), np.concatenate((s["c"], ids[c[good]])), np.concatenate((s["s"], score[good]))
        take = _best(q, score, c, k)
        s["q"], s["c"], s["s"] = q, c, score = q[take], c[take], score[take]
        got = np.bincount(q, minlength=len(s["ids"]))
        full = np.flatnonzero(got == k)
        last = (np.cumsum(got) - 1)[full]
        better = (score[last] > s["least"][full]) | ((score[last] == s["least"][full]) & (c[last] < s["least_id"][full]))
        s["least"][full[better]], s["least_id"][full[better]] = score[last][better], c[last][better]
        return True

    pairs = met.union(cands).repartition("g", "band", "part").sortWithinPartitions("g", "band", "part", "role", "order").mapInArrow(search, "query_id long, vec_id long, score long, beyond binary")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    out = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out, _ = staged(out, "top")
    drop_path(spark, path, asks_path, reached_path)
    return out


def top_k_sql(every: int = 50, k: int = 5) -> str:
    """The contract's query for DuckDB, over all pairs; ids must differ and scores fit a long."""
    return f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
