"""Best-two-fit packing of token pieces into fixed-length sequences.

Pieces matter to a packing only by their lengths, so the plan is made on the histogram
of lengths (at most ``limit`` numbers, whatever the corpus): bins are filled greedily
with the longest length that fits; then a bin's smallest document is replaced by two
unpacked ones that fill its expanded gap more tightly; and each pattern is used as often
as its lengths last. Spark then deals the pieces to the planned places: a piece's rank
within its length finds its bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, hf_encoder, no_clash, staged, text_chunks

#: Parts into which the pieces of a length are dealt to be ranked: so many, and one more for each so many pieces.
PARTS, RANKED = 64, 1_000_000
#: Units of text each generation of a worker's tokenizer cache holds: some 50 MB.
UNITS = 250_000


def best_two(counts: np.ndarray, gap: int, above: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum in (above, gap], or None."""
    lengths = np.flatnonzero(counts[: gap + 1])
    if not len(lengths):
        return None
    partner = np.searchsorted(lengths, gap - lengths, "right") - 1  # the longest that fits beside each
    partner = np.minimum(partner, np.arange(len(lengths)))
    # a length beside itself needs two of it
    alone = (partner == np.arange(len(lengths))) & (counts[lengths] < 2)
    partner = np.where(alone, partner - 1, partner)
    sums = np.where(partner >= 0, lengths + lengths[np.maximum(partner, 0)], 0)
    best = int(np.argmax(sums))
    if sums[best] <= above:
        return None
    return int(lengths[best]), int(lengths[partner[best]])


def plan(counts: np.ndarray, limit: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin) and how many bins each has; counts[n] pieces have length n.

    Every piece is in exactly one bin, and no bin is longer than ``limit``.
    """
    counts = counts.astype(np.int64).copy()
    out = []
    while (have := np.flatnonzero(counts)).size:
        items, gap = [], limit
        while True:
            fit = have[: np.searchsorted(have, gap, "right")]
            while len(fit) and not counts[fit[-1]]:
                fit = fit[:-1]
            if not len(fit) or fit[-1] == 0:
                break
            n = int(fit[-1])
            take = min(int(counts[n]), gap // n)
            items += [n] * take
            counts[n] -= take
            gap -= n * take
        while gap and len(items) > 1:
            small = items[-1]
            two = best_two(counts, gap + small, small)
            if two is None:
                break
            counts[small] += 1
            for n in two:
                counts[n] -= 1
            items = sorted([*items[:-1], *two], reverse=True)
            gap = limit - sum(items)
        lengths, each = np.unique(items, return_counts=True)
        more = int(min(counts[lengths] // each))
        counts[lengths] -= each * more
        out.append((items, 1 + more))
    return out


class Places:
    """For each length, runs of ranks and where they go."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for items, bins in patterns:
            offset = 0
            for n in items:  # one run of ``bins`` ranks for each place in the pattern
                rank = used.get(n, 0)
                runs.setdefault(n, []).append((rank, base, offset, bins))
                used[n] = rank + bins
                offset += n
            base += bins
        self.bins = base
        self.runs = {n: np.asarray(r, np.int64) for n, r in runs.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            runs = self.runs[int(n)]
            r = runs[np.searchsorted(runs[:, 0], ranks[at], "right") - 1]
            seq[at], off[at] = r[:, 1] + ranks[at] - r[:, 0], r[:, 2]
        return seq, off


def pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int, with_ids: bool = False, units: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut where longer than ``limit``.

    The first piece takes what the others of ``limit`` ids leave. Null texts are empty: one piece with the end id.
    """
    units = units or UNITS
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = hf_encoder(tokenizer, True, units)
        for b in batches:
            rows: list[tuple] = []
            keys = iter(b.column(0).to_pylist())
            for texts in text_chunks(b.column(1)):
                for ids in encoder(texts):
                    i, n = next(keys), len(ids) + 1
                    raw = np.append(ids.astype("<u4"), np.uint32(end_id)).tobytes()
                    start, end, piece = 0, n % limit or min(n, limit), 0
                    while start < n:
                        part = raw[4 * start : 4 * end]
                        rows.append((i, piece, start, end - start, zlib.crc32(part), part)[: len(schema)])
                        start, end, piece = end, end + limit, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def pack(cut: DataFrame, limit: int) -> DataFrame:
    """``cut`` (with doc_id, piece, length <= limit) and each row's sequence_id and offset.

    ``cut`` is read twice, so it should be a written table. Rows that are equal are ranked
    in any order, each once. Null ids are ranked like others. No rows give no rows. No
    column may be named sequence_id, offset, salt, salts or rank.
    """
    no_clash(cut.columns, "sequence_id", "offset", "salt", "salts", "rank")
    spark = cut.sparkSession
    columns = cut.columns
    counts = np.zeros(limit + 1, np.int64)
    for r in cut.groupBy("length").count().toPandas().itertuples():  # at most limit rows
        counts[r.length] = r[2]
    salts = counts // RANKED + PARTS
    more = np.flatnonzero(salts > PARTS)
    parts = F.lit(PARTS).cast("long")
    if len(more):
        cut = cut.join(F.broadcast(spark.createDataFrame(pa.table({"length": more.astype(np.int64), "salts": salts[more]}))), "length", "left")  # at most limit rows
        parts = F.coalesce("salts", parts)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), parts)).select(*columns, "salt")
    first = np.cumsum(salts) - salts  # where a length's parts begin in a flat table
    table = np.zeros(int(salts.sum()), np.int64)
    for r in cut.groupBy("length", "salt").count().toPandas().itertuples():  # at most limit * PARTS rows, and one for each RANKED pieces
        table[first[r.length] + r.salt] = r[3]
    before = np.cumsum(table) - table
    before -= np.repeat(before[first], salts)
    shared = spark.sparkContext.broadcast((first, before, Places(plan(counts, limit))))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, places = shared.value
        for b in batches:
            length, salt, rank = (np.asarray(b.column(c)) for c in ("length", "salt", "rank"))
            seq, off = places.find(length, before[first[length] + salt] + rank)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(seq), pa.array(off)], names=[*columns, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*columns).schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, ddl)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, units: int | None = None) -> DataFrame:
    """Pieces of all texts with sequence_id and offset: as few sequences of at most ``limit`` ids as best-two-fit finds.

    ``units`` bounds a worker's tokenizer cache (``UNITS``); fewer take less memory and more time.
    """
    cut, path = staged(pieces(docs, tokenizer, limit, end_id, units=units), "pieces")
    out, _ = staged(pack(cut, limit), "packed")
    drop_path(docs.sparkSession, path)
    return out
