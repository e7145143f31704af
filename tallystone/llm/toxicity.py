"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character 3- to 6-grams of small letters, of which none reaches over
the end of a word; every run of characters that are neither letters, digits nor marks is
one end. Each task counts, in how many labelled texts of each class a feature stands;
features whose log-count ratio is far beyond chance are kept, each indicator is scaled
by its ratio, and a hinge-loss model is fitted by dual coordinate descent. Indicators are
not divided by a text's length, so one insult counts alike in a short and in a long text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, drop_path, mix, no_clash, staged, with_text

BITS = 20
#: Lengths of the n-grams.
SHORTEST, LONGEST = 3, 6
#: Most labelled ids of each class, about, that the model is fitted on.
PER_CLASS = 4000
#: A feature is kept if it stands in so many labelled texts, and its ratio is so many standard deviations from none.
LEAST_TEXTS, DEVIATIONS = 3, 4.0
#: Texts weigh this much in a class's counts before any is seen, in the proportion of the classes.
PRIOR = 2.0
_BLANK = re.compile(r"[\W_]+")
#: Characters that are looked at together.
CHUNK = 1 << 19


def held_out() -> Column:
    """Rows that no model learns from: crc32(doc_id as text) mod 5 = 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def normal(text: str | None) -> str:
    """Small letters, each run of other characters than letters and digits as one blank, and one at both ends."""
    return f" {_BLANK.sub(' ', text.lower()).strip()} " if text else ""


def grams(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each text's distinct n-grams, in order; with ``wanted`` (a flag for each feature) of those only."""
    rows, found = [], []
    clean = [normal(t) for t in texts]
    sizes = np.asarray([len(t) for t in clean], np.int64)
    i = 0
    while i < len(clean):
        j, room = i + 1, CHUNK - sizes[i]
        while j < len(clean) and sizes[j] <= room:
            room -= sizes[j]
            j += 1
        codes = np.frombuffer("".join(clean[i:j]).encode("utf-32-le", "replace"), np.uint32)
        owner = np.repeat(np.arange(i, j), sizes[i:j])
        values = mix(codes.astype(U64) + U64(0x51ED2701))
        blank = np.cumsum(np.append(0, codes == 32))
        h, mine = values.copy(), []
        for n in range(2, LONGEST + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = h[:m] * U64(0x9E3779B97F4A7C15) + values[n - 1 :]
            if n < SHORTEST:
                continue
            # no blank but at the ends, where it marks the word's; texts begin and end with one, so none is crossed
            inside = blank[n - 1 : n - 1 + m] == blank[1 : m + 1]
            at = np.flatnonzero(inside)
            ids = (mix(h[at] + U64(n)) >> U64(64 - BITS)).astype(np.int64)
            if wanted is not None:
                kept = wanted[ids]
                at, ids = at[kept], ids[kept]
            mine.append(owner[at] << BITS | ids)
        both = np.unique(np.concatenate(mine)) if mine else np.zeros(0, np.int64)
        rows.append(both >> BITS)
        found.append(both & ((1 << BITS) - 1))
        i = j
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ratios(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log-count ratios of the features (toxic over other) from the counts of texts (2 x features) and of all texts of both classes.

    0 for features that are rare or whose ratio chance may give. A feature that neither class has seen would have 0, whatever the classes' sizes.
    """
    share = texts / texts.sum()
    smooth = counts + PRIOR * share[:, None]
    ratio = np.log(smooth[1] / (texts[1] + PRIOR * share[1])) - np.log(smooth[0] / (texts[0] + PRIOR * share[0]))
    total = counts.sum(axis=0)
    # how far the toxic texts' share of a feature's texts is from theirs of all, in its standard deviations
    far = np.abs(counts[1] - total * share[1]) / np.sqrt(np.maximum(total, 1) * share[0] * share[1])
    return np.where((total >= LEAST_TEXTS) & (far >= DEVIATIONS), ratio, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Weights of the features (ratios multiplied in), bias, and the scale that turns a margin to a log odds."""
    weights = np.zeros(len(ratio))
    if not len(rows) or labels.min() == labels.max():
        return weights, (4.0 if labels[0] else -4.0) if len(rows) else 0.0, 1.0
    scaled = [ratio[ids] for ids in rows]
    norms = np.asarray([x @ x + 1.0 for x in scaled])
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.asarray([(labels == 0).mean(), (labels == 1).mean()])
    most = cost / (2 * share[labels])  # both classes weigh alike
    b, alpha, rng = 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            grad = sign[i] * (weights[rows[i]] @ scaled[i] + b) - 1
            new = min(max(alpha[i] - grad / norms[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[rows[i]] += step * scaled[i]
                b += step
                alpha[i] = new
    margin = np.asarray([weights[ids] @ x + b for ids, x in zip(rows, scaled, strict=True)])
    grid = np.asarray([0.5, 1, 2, 3, 4, 6])
    loss = [np.logaddexp(0, -sign * margin * g).mean() for g in grid]
    return weights * ratio, b, float(grid[int(np.argmin(loss))])


def sampled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(toxic, text) of at most about ``per_class`` labelled ids of each class that aren't held out, chosen by a hash of the id.

    Of an id's several texts the least one counts, of repeated labels each value once.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out()).distinct()
    share = F.lit(0.0)
    for r in known.groupBy("toxic").count().collect():  # two rows
        share = F.when(F.col("toxic") == r.toxic, F.lit(min(1.0, per_class / r[1]))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))  # 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float, float]:
    """The model, from whole texts of at most about ``per_class`` labelled ids of each class; held-out rows take no part."""
    rows, path = staged(sampled(docs, labels, per_class), "labelled-texts")
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of each class, and those with each feature, as far as this task sees."""
        counts, texts = np.zeros((2, size), np.int32), np.zeros(2, np.int64)
        for b in batches:
            toxic = np.asarray(b.column(0))
            texts += np.bincount(toxic, minlength=2)
            row, ids = grams(b.column(1).to_pylist())
            for y in (0, 1):
                counts[y] += np.bincount(ids[toxic[row] == y], minlength=size).astype(np.int32)
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[0, used], texts[0]), pa.int64()), pa.array(np.append(counts[1, used], texts[1]), pa.int64())], names=["id", "n0", "n1"])

    summed = rows.coalesce(8).mapInArrow(count, "id long, n0 long, n1 long").groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # a row a feature at most
    ids, n = summed.column(0).to_numpy(), np.stack([summed.column(1).to_numpy(), summed.column(2).to_numpy()])
    counts = np.zeros((2, size))
    counts[:, ids[ids >= 0]] = n[:, ids >= 0]
    texts = n[:, ids < 0].sum(axis=1)
    if not texts.all():  # no label, or one kind of label
        drop_path(docs.sparkSession, path)
        return np.zeros(size), 4.0 * np.sign(texts[1] - texts[0]), 1.0
    ratio = ratios(counts, texts)
    wanted = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ids = grams(b.column(1).to_pylist(), wanted.value)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))], names=["toxic", "ids"])

    got = rows.mapInArrow(kept, "toxic int, ids array<int>").toPandas()
    drop_path(docs.sparkSession, path)
    got = got.sort_values(["toxic", "ids"], key=lambda c: c if c.name == "toxic" else c.map(lambda x: np.asarray(x, ">i4").tobytes()), kind="stable")  # any order of tasks gives one model
    return fit([np.asarray(x, np.int64) for x in got["ids"]], got["toxic"].to_numpy(), ratio)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score (0 to 1, higher: more likely toxic) and predicted of every row, from its whole text alone.

    Null and empty texts, and those without a letter or digit, get the model's bias; null or repeated ids
    are scored like others; texts of any length are read whole. With labels of one kind all scores are
    on its side, without labels all are 0.5. An empty table gives no rows. ``keep`` may not name a
    column score or predicted; other columns are not looked at.
    """
    no_clash(keep, "score", "predicted")
    weights, bias, scale = train(docs, labels, per_class)
    model = docs.sparkSession.sparkContext.broadcast((weights, weights != 0))
    rows, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, wanted = model.value
        for b in batches:
            row, ids = grams(b.column(at).to_pylist(), wanted)
            margin = np.bincount(row, w[ids], minlength=b.num_rows) + bias
            score = 1 / (1 + np.exp(-np.clip(margin * scale, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = docs.select(*keep).schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    return rows.mapInArrow(run, ddl)
