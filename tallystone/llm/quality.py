"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each feature's indicator is scaled by the log ratio of its class counts, and a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent.
Features are hashed word 1- and 2-grams, 1- to 3-grams of word shapes (runs of upper
case, other letters, digits, and each sign), and repetitions: three words that equal
those some places back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, _PINV, U64, binary_parts, byte_chunks, held_out, mix, no_clash, powers, with_text, words_of

BITS = 18
#: Most labelled rows of each class that the model is fitted on.
PER_CLASS = 1500
LAGS = 16
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3
_KIND_RAND = mix(np.arange(300, 556, dtype=U64) * U64(0x9FB21C651E98DF25))


def _pairs(h: np.ndarray, doc: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row of one document, and their documents."""
    if len(h) < n:
        return h[:0], doc[:0]
    m = len(h) - n + 1
    out = np.full(m, seed, U64)
    for i in range(n):
        out = mix(out * U64(0xC2B2AE3D27D4EB4F) + h[i : m + i])
    same = doc[:m] == doc[n - 1 :]
    return out[same], doc[:m][same]


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the distinct ids of its features; none for an empty or null one."""
    raw, offsets = binary_parts(column)
    mark = np.zeros(1 << BITS, np.int32)
    for i, j in byte_chunks(offsets):
        part = offsets[i : j + 1] - offsets[i]
        text = raw[offsets[i] : offsets[j]]
        starts, ends, words, doc = words_of(text, part)
        kind = _KIND[text]
        turn = np.ones(len(text), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turn[starts] = True
        kept = np.flatnonzero(turn)
        sums = np.zeros(len(kept) + 1, U64)
        if len(kept):
            np.cumsum(_KIND_RAND[kind[kept]] * powers(_P, len(kept)), out=sums[1:])
        first, last = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
        shapes = mix((sums[last] - sums[first]) * powers(_PINV, max(1, len(kept)))[np.minimum(first, max(0, len(kept) - 1))] + (last - first).astype(U64)) if len(starts) else words
        found = [_pairs(words, doc, 1, 11), _pairs(words, doc, 2, 12), _pairs(shapes, doc, 1, 21), _pairs(shapes, doc, 2, 22), _pairs(shapes, doc, 3, 23)]
        for lag in range(1, LAGS + 1):
            m = len(words) - lag - 2
            if m <= 0:
                break
            same = words[lag:] == words[:-lag]
            run = same[:m] & same[1 : m + 1] & same[2 : m + 2] & (doc[:m] == doc[lag + 2 :])
            at = np.flatnonzero(run)
            found.append((np.full(len(at), mix(np.full(1, 1000 + lag, U64))[0]), doc[at]))
        ids = np.concatenate([(h >> U64(64 - BITS)).astype(np.int64) for h, _ in found])
        owner = np.concatenate([d for _, d in found])
        order = np.argsort(owner, kind="stable")
        ids, at = ids[order], np.searchsorted(owner[order], np.arange(j - i + 1))
        for d in range(j - i):
            own = ids[at[d] : at[d + 1]]
            n = np.arange(len(own), dtype=np.int32)
            mark[own] = n
            yield own[mark[own] == n]


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Weights of features, bias, and the scale that turns a margin to a log odds."""
    size = 1 << BITS
    if not len(rows) or labels.min() == labels.max():
        return np.zeros(size), (4.0 if len(rows) and labels[0] else -4.0) if len(rows) else 0.0, 1.0
    counts = np.ones((2, size))
    for ids, y in zip(rows, labels, strict=True):
        counts[y, ids] += 1
    ratio = np.log(counts[1] / (1 + (labels == 1).sum())) - np.log(counts[0] / (1 + (labels == 0).sum()))
    scaled = [ratio[ids] / math.sqrt(max(1, len(ids))) for ids in rows]
    norms = np.asarray([x @ x + 1.0 for x in scaled])
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.asarray([(labels == 0).mean(), (labels == 1).mean()])
    most = cost / (2 * share[labels])  # both classes weigh alike
    w, b, alpha, rng = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            grad = sign[i] * (w[rows[i]] @ scaled[i] + b) - 1
            new = min(max(alpha[i] - grad / norms[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * scaled[i]
                b += step
                alpha[i] = new
    margin = np.asarray([w[ids] @ x + b for ids, x in zip(rows, scaled, strict=True)])
    grid = np.asarray([0.5, 1, 2, 3, 4, 6])
    loss = [np.logaddexp(0, -sign * margin * g).mean() for g in grid]
    return w * ratio, b, float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float, float]:
    """The model, from at most about ``per_class`` labelled ids of each quality, chosen by a hash of the id; held-out rows take no part.

    Of an id's several texts the least one counts, of repeated labels each value once.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out()).distinct()
    share = F.lit(0.0)
    for r in known.groupBy("quality").count().collect():  # two rows
        share = F.when(F.col("quality") == r.quality, F.lit(min(1.0, per_class / r[1]))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(features(b.column(1))), pa.list_(pa.int64()))], names=["quality", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.select("quality", "text").mapInArrow(run, "quality int, ids array<long>").toPandas()
    rows = rows.sort_values("ids", key=lambda c: c.map(lambda x: (len(x), int(np.sum(x)))), kind="stable")  # any order of tasks gives one model
    return fit([np.asarray(x, np.int64) for x in rows["ids"]], rows["quality"].to_numpy())


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score (0 to 1, higher: better) and predicted of every row, from its whole text alone.

    Null and empty texts get the model's bias; null or repeated ids are scored like others;
    texts of any length are read whole. Without labels of both kinds every row gets the same
    score. ``keep`` may not name a column score or predicted.
    """
    no_clash(keep, "score", "predicted")
    w, b, scale = train(docs, labels, per_class)
    model = docs.sparkSession.sparkContext.broadcast((w.astype(np.float64), b, scale))
    rows, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, k = model.value
        for batch in batches:
            margin = np.asarray([weights[ids].sum() / math.sqrt(max(1, len(ids))) + bias for ids in features(batch.column(at))], np.float64)
            score = 1 / (1 + np.exp(-np.clip(margin * k, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = docs.select(*keep).schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    return rows.mapInArrow(run, ddl)
