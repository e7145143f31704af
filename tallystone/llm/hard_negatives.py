"""Hard-negative mining: for anchors and their positives, the best rows of other labels within a window of scores.

Rows are sorted by norm into buckets. A group of anchors meets a bucket only where the
Cauchy-Schwarz bound, anchor's norm times the bucket's greatest, reaches one of its windows'
lower limits, or the score that the window's k-th row already has. In a bucket, rows come
by descending norm in batches, and the same bound ends the search. Positives are found by
the same search, with one open window an anchor. Scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, range_cuts, range_part, staged
from .topk import _as_float, _as_long, _best, _beyond, _matrix, _products, integer_vectors

#: Rows of a bucket, anchors of a group, rows scored at once, and the longest rows, which give first limits.
BUCKET, ANCHORS, STEP, SEEDS = 16384, 1024, 512, 1024
#: Most buckets; so many norms reach the driver.
MOST_BUCKETS = 256

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def exact(score: int, beyond: bytes) -> int:
    """The integer that a clipped score and its further bytes stand for."""
    if beyond[:1] == b"\x01":
        return score
    raw = beyond[1:] if beyond[:1] == b"\x02" else bytes(255 - c for c in beyond[1:])
    value = int.from_bytes(raw[2:], "big")
    return value if beyond[:1] == b"\x02" else -value


def _integers(values: list[int]) -> np.ndarray:
    """int64 where all fit, else Python's integers."""
    return np.asarray(values, np.int64 if all(_LOW <= v <= _HIGH for v in values) else object)


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a, b) if a.dtype == b.dtype else (a.astype(object), b.astype(object))


class Anchors:
    """Anchors of a group with their windows [low, high], and each window's k best rows so far."""

    def __init__(self, ids, labels, m, norm, windows, k: int, same: bool):
        self.ids, self.labels, self.m, self.norm, self.k, self.same = ids, labels, m, norm, k, same
        self.owner = np.repeat(np.arange(len(ids)), [len(w) for w in windows])
        self.number = np.concatenate([np.arange(len(w)) for w in windows]) if len(windows) else np.zeros(0, np.int64)
        self.least, self.high = _integers([low for w in windows for low, _ in w]), _integers([high for w in windows for _, high in w])
        self.least_id = np.full(len(self.owner), _HIGH)
        self.w, self.c, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def step(self, ids, labels, m, norm) -> bool:
        """Take in a batch of rows; False if no window can be reached by rows of such norms."""
        reach = self.norm[self.owner] * norm.max(initial=0.0) * (1 + 1e-9) + 1e-6
        live = np.flatnonzero(~(reach < _as_float(self.least)))
        if not len(live):
            return False
        used, at = np.unique(self.owner[live], return_inverse=True)
        score = _products(self.m[used], m, self.norm[used], norm)
        fine = (self.ids[used, None] != ids[None, :]) & ((self.labels[used, None] == labels[None, :]) == self.same)
        least, high = self.least[live, None], self.high[live, None]
        own = score[at]
        w, c = np.nonzero(fine[at] & (own >= least) & (own <= high))
        found = own[w, c]
        w = live[w]
        found, at_least = _fit(found, self.least[w])
        good = (found > at_least) | (ids[c] <= self.least_id[w])
        held, found = _fit(self.s, found[good])
        w, c, s = np.concatenate((self.w, w[good])), np.concatenate((self.c, ids[c[good]])), np.concatenate((held, found))
        take = _best(w, s, c, self.k)
        self.w, self.c, self.s = w, c, s = w[take], c[take], s[take]
        full = np.flatnonzero(np.bincount(w, minlength=len(self.owner)) == self.k)
        last = np.searchsorted(w, full, "right") - 1
        self.least, s = _fit(self.least, s)
        self.least = self.least.copy()
        self.least[full], self.least_id[full] = s[last], c[last]
        return True


def windowed(data: DataFrame, asks: DataFrame, windows_of, k: int, same: bool) -> DataFrame:
    """(anchor_id, window, rank, vec_id, score, beyond): the k best rows of each window of each anchor.

    ``data`` are (vec_id, label, v, norm), ``asks`` the same with a column ``given``, of which ``windows_of``
    makes the list of windows; rows count that have the anchor's label (``same``) or another one, and another id.
    """
    spark = data.sparkSession
    size = data.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    dim = max(1, size.dim)
    n_bands = max(1, min(MOST_BUCKETS, size.n // BUCKET))
    data = data.withColumn("band", range_part(F.col("norm"), range_cuts(data, "norm", n_bands, every=True), "double"))
    buckets = data.groupBy("band").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts"), F.max("norm").alias("longest"))
    seeds = data.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "label", "v", "norm").toArrow().combine_chunks()
    held = spark.sparkContext.broadcast((np.asarray(seeds.column(0)), np.asarray(seeds.column(1)), _matrix(seeds.column(2).combine_chunks(), dim), np.asarray(seeds.column(3))))

    def group_of(b: pa.RecordBatch, first: int) -> Anchors:
        return Anchors(np.asarray(b.column(first)), np.asarray(b.column(first + 1)), _matrix(b.column(first + 2), dim), np.asarray(b.column(first + 3)), [windows_of(x) for x in b.column(first + 4).to_pylist()], k, same)

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least share of the greatest norm at which one of an anchor's windows can still be reached."""
        for b in batches:
            needs = []
            for i in range(0, b.num_rows, ANCHORS):
                group = group_of(b.slice(i, ANCHORS), 0)
                for j in range(0, len(held.value[0]), STEP):
                    group.step(*(x[j : j + STEP] for x in held.value))
                least = np.full(len(group.ids), np.inf)
                np.minimum.at(least, group.owner, _as_float(group.least))
                with np.errstate(divide="ignore", invalid="ignore"):
                    needs.append(np.where(group.norm > 0, least / group.norm, np.where(least > 0, 1e300, -1e300)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(needs) if needs else [], pa.float64())], names=[*b.schema.names, "needs"])

    columns = ["vec_id", "label", "v", "norm", "given"]
    kind = asks.select("given").schema[0].dataType.simpleString()
    asked, asked_path = staged(asks.select(*columns).mapInArrow(limits, f"vec_id long, label long, v array<double>, norm double, given {kind}, needs double"), "anchors")
    # anchors that need similar norms go together, so that a bucket of short rows meets few of their groups
    cuts = range_cuts(asked, "needs", max(1, math.ceil(asked.count() / ANCHORS)), every=True)
    asked = asked.withColumn("range", range_part(F.col("needs"), cuts, "double"))
    first, per_range = 0, []
    for r in sorted(asked.groupBy("range").count().collect()):  # at most 16,384 rows
        per_range.append((r["range"], first, math.ceil(r["count"] / ANCHORS)))
        first += per_range[-1][2]
    ranges = spark.createDataFrame(per_range, "range int, first int, groups int")
    asked = asked.join(F.broadcast(ranges), "range").withColumn("g", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
    met = asked.join(F.broadcast(buckets), F.col("longest") * (1 + 1e-9) + F.when(F.col("norm") > 0, 1e-6 / F.col("norm")).otherwise(1e-6) >= F.col("needs"))  # at most MOST_BUCKETS rows
    reached, reached_path = staged(met.groupBy("band").agg(F.max("g").alias("last")).join(buckets, "band").select("band", "last", "parts"), "reached")
    met = met.select("g", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.lit(0.0).alias("order"), *columns)
    rows = data.join(F.broadcast(reached), "band").select(
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("g"), "band", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), (-F.col("norm")).alias("order"), "vec_id", "label", "v", "norm", F.lit(None).cast(kind).alias("given")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, group, over = None, [], None, False

        def found() -> Iterator[pa.RecordBatch]:
            if group is not None and len(group.w):
                anchor, window = group.ids[group.owner[group.w]], group.number[group.w]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window, pa.int32()), pa.array(group.c), pa.array(_as_long(group.s)), pa.array(_beyond(group.s), pa.binary())], names=["anchor_id", "window", "vec_id", "score", "beyond"])

        for b in batches:
            keys = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(4)])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *change], [*change, b.num_rows], strict=True):
                if z == a:
                    continue
                part = b.slice(a, z - a)
                if tuple(keys[:3, a]) != key:
                    yield from found()
                    key, waiting, group, over = tuple(keys[:3, a]), [], None, False
                if keys[3, a] == 0:
                    waiting.append(part)
                    continue
                if waiting:  # all anchors of the group are here, and rows begin
                    group, waiting = group_of(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], 5), []
                for i in range(0, part.num_rows if group is not None and not over else 0, STEP):
                    few = part.slice(i, STEP)
                    if not group.step(np.asarray(few.column(5)), np.asarray(few.column(6)), _matrix(few.column(7), dim), np.asarray(few.column(8))):
                        over = True  # rows come by descending norm
                        break
        yield from found()

    pairs = met.union(rows).repartition("g", "band", "part").sortWithinPartitions("g", "band", "part", "role", "order").mapInArrow(search, "anchor_id long, window int, vec_id long, score long, beyond binary")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    out, _ = staged(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor_id", "window", "rank", "vec_id", "score", "beyond"), "windows")
    drop_path(spark, asked_path, reached_path)
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` are (vec_id, label, v array<double>, norm) as of ``labelled_vectors``; ``anchors`` says which
    rows ask. An anchor's positives are the ``positives`` best rows of its label and another id, its
    negatives the ``negatives`` best of other labels with low * p <= 100 * score <= high * p for the
    positive's score p. Ties go to the smaller vec_id; where fewer rows fit, fewer are returned.
    Repeated rows each count; of several anchor rows with one id the least label's least vector
    asks. Shorter vectors count as zero beyond their end. Empty tables, single labels and windows
    without rows give no rows. Scores are compared exactly at any size; one beyond a long is given as
    the nearest long. Each bucket is copied to every group of anchors that reaches it.
    """
    spark = vectors.sparkSession
    data, path = staged(vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"), "norm"), "labelled")
    asks = data.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm")).alias("ask")).select("vec_id", "ask.label", "ask.v", "ask.norm")
    asks, asks_path = staged(asks, "asks")
    if not asks.take(1):
        drop_path(spark, path, asks_path)
        return spark.createDataFrame([], RESULT)
    edge = 1 << 4096  # beyond any score
    best = windowed(data, asks.withColumn("given", F.lit(None).cast("int")), lambda _: [(-edge, edge)], positives, same=True)
    given = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "beyond"))).alias("given"))  # ``positives`` each
    asks2 = asks.join(given, asks.vec_id == given.anchor_id).select("vec_id", "label", "v", "norm", "given")

    def windows(given: list[dict]) -> list[tuple[int, int]]:
        scores = [exact(x["score"], x["beyond"]) for x in given]
        return [(-(-low * p // 100), high * p // 100) for p in scores]

    out = spark.createDataFrame([], RESULT)
    if best.take(1):
        found = windowed(data, asks2, windows, negatives, same=False)
        positive = best.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = found.join(positive, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out, _ = staged(out, "negatives")
    drop_path(spark, path, asks_path)
    return out


def labelled_vectors(table: DataFrame, label: Column, label_col: str = "label") -> DataFrame:
    """(vec_id, label, v, norm) of the rows that have an id, a label and finite components; ``label`` is what counts as their label."""
    known = table.where(F.col(label_col).isNotNull()).select("vec_id", label.cast("long").alias("label"), "embedding")
    return integer_vectors(known, keep=("label",))


def hard_negatives_sql() -> str:
    """The contract's query for DuckDB; scores must fit a long."""
    return """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor, p.other AS positive, p.score AS ps, s.other AS negative, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3"""
