"""Document fingerprints by winnowing, and the comparison of each text with an edit of it.

Every k-gram of code points gets a rolling hash; of every w neighbouring hashes the
smallest is chosen, the rightmost of equals, and its position kept. Any passage of
w + k - 1 code points that two texts share leaves a common fingerprint in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, even_slots, mix, powers, range_cuts, range_part

K, W = 12, 16
_BASE = 0xB5297A4D3F84D5B5 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order. A text under k code points is one gram; an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    size = min(k, n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(points.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
    m = n - size + 1
    least = mix((sums[size:] - sums[:m]) * powers(_INVERSE, m) + U64(size))
    at = np.arange(m)
    span, width = 1, min(w, m)
    while span < width:
        step = min(span, width - span)
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return least[new], at[new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two fingerprints' distinct hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shown(hashes: np.ndarray) -> str:
    """The upper 32 bits of each chosen hash as 8 hexadecimal digits, in order."""
    return (hashes >> U64(32)).astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes array<long>, positions array<long>) of every whole text, however long; a null text is empty. Ids may repeat or be null; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [winnow(t or "", k, w) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h.view(np.int64) for h, _ in marks], pa.list_(pa.int64())), pa.array([p for _, p in marks], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def in_order_with_next(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text) such that within each part, sorted, every row is followed by the next one of the table.

    Parts are ranges of doc_id (null first), cut at quantiles. The first row of the next
    part (of the whole table, after the last) follows each part as a guest, so one shuffle
    of the texts is enough and no task sees more than its range. One id a part reaches the
    driver, 16384 at most.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    part = range_part(F.col("doc_id"), [int(c) for c in range_cuts(docs, "doc_id")], "bigint")
    own = docs.select(part.alias("part"), F.lit(0).alias("guest"), "doc_id", "text")
    # min over (is it not null, id) keeps null ids first
    first = sorted((r.part, r.low.id) for r in own.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("id"))).alias("low")).collect())
    if not first:
        return own
    follows = spark.createDataFrame([(i, p) for (p, _), (_, i) in zip(first, [*first[1:], first[0]], strict=True)], "head long, part int")  # a row a part
    heads = [i for _, i in first if i is not None]
    some = F.col("doc_id").isin(heads) if heads else F.lit(False)
    if any(i is None for _, i in first):
        some = some | F.col("doc_id").isNull()
    lent = docs.where(some).join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("head"))).select("part", F.lit(1).alias("guest"), "doc_id", "text")
    slots = spark.createDataFrame(list(zip([p for p, _ in first], even_slots(spark, len(first)), strict=True)), "part int, slot long")
    dealt = own.union(lent).join(F.broadcast(slots), "part").repartition(len(first), "slot")
    return dealt.select("part", "guest", "doc_id", "text").sortWithinPartitions("part", "guest", "doc_id", "text")


def edit_report(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each text's fingerprint against that of its edit and of the next text.

    The edit replaces the last floor(n/2) code points by the first as many (or all) of the
    next text by doc_id; after the last comes the first. Null texts are empty, null ids come
    first, rows of one id are ordered by text, a single row follows itself, no rows give none.
    Texts of any length are taken whole. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and the positions of the fingerprint's hashes.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("positions", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row that still waits for its next
        for b in batches:
            out = []
            for part, guest, i, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if guest and (held is None or held[0] != part):
                    continue  # a further row with the guest's id
                marks, places = winnow(text, k, w)
                if held is not None:
                    _, j, old, old_marks, old_places = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    edited_marks = winnow(edited, k, w)[0]
                    out.append((j, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(old_marks), shown(edited_marks), likeness(old_marks, edited_marks), likeness(old_marks, marks), old_places))
                held = None if guest else (part, i, text, marks, places)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    return in_order_with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>")
