"""Content-addressed store of token ids.

Each document's ids are cut where a rolling hash of the last ids says so, so equal
passages give equal chunks wherever they stand. The store's folder holds

``chunks/``   digest, ids (little-endian, 2 or 4 bytes each): every distinct chunk once
``recipes/``  part, doc_id, start, n_tokens, digests, root: documents in ascending doc_id order
``manifest/`` part, documents, first and last token, Merkle root of the part's document roots
``format/``   bytes of an id and the end id

A document's root is the Merkle root of its chunk digests; reading recomputes digests,
document roots and part roots, and fails on any difference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, drop_path, hf_encoder, mix, powers, range_cuts, range_part, shuffles_dropped, staged, text_chunks

DIGEST = 16
CHUNKS = "digest binary, ids binary"
RECIPES = "part int, doc_id long, start long, n_tokens long, digests binary, root binary"
MANIFEST = "part int, documents long, first long, last long, root binary"
#: Ids the rolling hash sees, and the least, mean and greatest ids of a chunk.
ROLL, LEAST, MEAN, MOST = 8, 64, 256, 1024
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places of a stream that may end a chunk: where the hash of the ``ROLL`` ids before says so."""
    n = len(ids)
    if n < ROLL:
        return np.zeros(0, np.int64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(ids.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
    rolling = mix((sums[ROLL:] - sums[:-ROLL]) * powers(_INVERSE, n)[: n + 1 - ROLL])
    return np.flatnonzero((rolling & U64(MEAN - 1)) == 0) + ROLL


def chunk_ends(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids with such marks."""
    if n <= LEAST:
        return [n] if n else []
    out, last = [], 0
    for m in at:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            out.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, by content alone."""
    return chunk_ends(len(ids), marks(ids).tolist())


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is, no leaves give the digest of nothing."""
    if not digests:
        return hashlib.sha256(b"").digest()[:DIGEST]
    level = [hashlib.sha256(b"\0" + d).digest()[:DIGEST] for d in digests]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest()[:DIGEST] for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0]


def _shift_tables() -> list[np.ndarray]:
    """For each power of two of zero bytes that follow, what becomes of each byte of a crc32: 4 x 256 numbers."""
    bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
    matrix = np.asarray([((c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1) for c in (1 << np.arange(32)).tolist()], np.uint64)  # one zero bit; columns as numbers

    def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduce(np.where(y[:, None] & bit, x[None, :], np.uint64(0)), axis=1)

    for _ in range(3):
        matrix = times(matrix, matrix)
    bits, out = (np.arange(256)[:, None] >> np.arange(8)) & 1, []
    for _ in range(48):
        out.append(np.stack([np.bitwise_xor.reduce(np.where(bits, matrix[8 * i : 8 * i + 8][None, :], np.uint64(0)), axis=1) for i in range(4)]).astype(np.int64))
        matrix = times(matrix, matrix)
    return out


_shifts: list[np.ndarray] = []


def crc_shifted(crcs: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each crc32 as if so many zero bytes came after it; the crc32 of joined strings is the XOR of theirs, each shifted by what follows it."""
    if not _shifts:
        _shifts.extend(_shift_tables())
    out, left, power = crcs.astype(np.int64), zeros.astype(np.int64), 0
    while left.any():
        at = np.flatnonzero(left & 1)
        c, t = out[at], _shifts[power]
        out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        left, power = left >> 1, power + 1
    return out


class CrcJoin:
    """crc32 of two byte strings in a row, from theirs and the second one's length."""

    def __call__(self, crc: int, other: int, length: int) -> int:
        return int(crc_shifted(np.asarray([crc]), np.asarray([length]))[0]) ^ other


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, keeps_space: bool = False) -> None:
    """Encode every text (null: empty), append ``end_id``, and write the store to ``path``.

    Rows may repeat or have null ids (these come first); rows of one id are ordered by root.
    An empty table gives an empty store.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("root", pa.binary()), ("digest", pa.binary()), ("ids", pa.binary())])
    width = 4 if end_id > 0xFFFF else hf_encoder(tokenizer, keeps_space).dtype.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, tail = hf_encoder(tokenizer, keeps_space), set(), np.asarray([end_id], f"<u{width}")
        for b in batches:
            keys = iter(b.column(0).to_pylist())
            for texts in text_chunks(b.column(1), 1 << 22):
                rows: list[tuple] = []
                # the documents' ids in a row, marked in one go; a mark whose hash reaches into another document is none
                each = [x for ids in encoder(texts) for x in (ids, tail)]
                stream = np.concatenate(each).astype(f"<u{width}", copy=False)
                where, whole = marks(stream), stream.tobytes()
                ends = np.cumsum([len(x) for x in each])[1::2]
                begins = np.append(0, ends[:-1])
                low, high = np.searchsorted(where, begins + ROLL, "left"), np.searchsorted(where, ends, "right")
                for begin, stop, i, j in zip(begins.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
                    raw, n = whole[begin * width : stop * width], stop - begin
                    last, digests = 0, []
                    for end in chunk_ends(n, (where[i:j] - begin).tolist() if n > LEAST else []):
                        part = raw[last * width : end * width]
                        last = end
                        d = hashlib.sha256(part).digest()[:DIGEST]
                        digests.append(d)
                        if d not in seen:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen.add(d)
                            rows.append((None, None, None, None, d, part))
                    rows.append((next(keys), n, b"".join(digests), merkle(digests), None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    ddl = "doc_id long, n_tokens long, digests binary, root binary, digest binary, ids binary"
    raw, raw_path = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl), "encoded")
    with shuffles_dropped(spark):
        # tasks have dropped most repeats themselves, so chunks are dealt without being sorted first
        raw.where("digest is not null").select("digest", "ids").repartition("digest").groupBy("digest").agg(F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    # token offsets: sums of ranges of doc_id, then running sums within each
    recipes = raw.where("root is not null").select("doc_id", "n_tokens", "digests", "root")
    part = range_part(F.col("doc_id"), [int(c) for c in range_cuts(recipes, "doc_id")], "bigint")
    recipes = recipes.withColumn("part", part)
    base, rows = 0, []
    for r in recipes.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row a part: 16384 at most
        rows.append((r.part, base))
        base += r.n
    bases = F.broadcast(spark.createDataFrame(rows, "part int, base long"))
    w = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.withColumn("before", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(bases, "part")
    placed.select("part", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "digests", "root").sortWithinPartitions("part", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merkle root of each part, whose rows come in order."""
        part, held, out = None, [], []
        for b in batches:
            for p, start, n, root in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if p != part and held:
                    out.append((part, len(held), first, last, merkle(held)))
                    held = []
                if not held:
                    part, first = p, start
                held.append(root)
                last = start + n
        if held:
            out.append((part, len(held), first, last, merkle(held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "documents", "first", "last", "root"])

    written = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", "start", "n_tokens", "root")
    written.repartition("part").sortWithinPartitions("part", "start").mapInArrow(roots, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(width, end_id)], "width int, end_id int").coalesce(1).write.parquet(f"{path}/format")
    drop_path(spark, raw_path)


def _positions(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens, root, chunks, pos, digest): each chunk of each recipe."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").withColumn("chunks", (F.length("digests") / DIGEST).cast("int"))
    each = recipes.select("part", "doc_id", "start", "n_tokens", "root", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("pos"), "digests")
    return each.withColumn("digest", F.expr(f"substring(digests, pos * {DIGEST} + 1, {DIGEST})")).drop("digests")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the chunks' bytes; broken stores fail.

    Every chunk is read once, its digest recomputed and its ids' crc32 taken; the crc32 of a
    document is joined from those of its chunks, so no id crosses the network twice.
    """
    width = spark.read.parquet(f"{path}/format").first().width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if hashlib.sha256(raw).digest()[:DIGEST] != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
                out.append((d, len(raw) // width, zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["digest", "n", "crc"])

    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("digest", "ids").mapInArrow(sums, "digest binary, n long, crc long")
    rows = _positions(spark, path).join(chunks, "digest", "left").join(F.broadcast(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", F.col("root").alias("part_root"))), "part")  # one row a part: 16384 at most
    rows = rows.select("part", "start", "pos", "doc_id", "n_tokens", "root", "chunks", "digest", "n", "crc", "part_root")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, part, roots, want = CrcJoin(), None, [], None
        held = ([], 0, 0)  # digests, crc32 and ids of a document that goes on into the next batch

        def close():
            if roots and merkle(roots) != want:
                raise ValueError(f"part {part} does not match its Merkle root")

        for b in batches:
            if not b.num_rows:
                continue
            parts, start, pos, doc, total, root, count, digest, size, crc, part_root = b.columns
            pos, count = np.asarray(pos), np.asarray(count)
            due = np.append(len(held[0]), np.where(pos[:-1] == count[:-1] - 1, 0, pos[:-1] + 1))
            if size.null_count or (pos != due).any():
                at = int(np.flatnonzero(np.asarray(size.is_null()) | (pos != due))[0])
                raise ValueError(f"a chunk of document {doc[at].as_py()} is missing")
            size = np.asarray(size)
            begin = np.unique(np.append(0, np.flatnonzero(pos == 0)))
            end = np.append(begin[1:], len(pos))
            sums = np.cumsum(size)
            after = np.repeat(sums[end - 1], end - begin) - sums
            crcs = np.bitwise_xor.reduceat(crc_shifted(np.asarray(crc), 4 * after), begin)
            ids = np.diff(np.append(0, sums[end - 1]))
            digests = digest.to_pylist()
            first = pa.array(begin)
            columns = [x.take(first).to_pylist() for x in (parts, start, doc, total, root, part_root)]
            out = []
            for a, z, c, n, p, s, d, t, r, pr in zip(begin.tolist(), end.tolist(), crcs.tolist(), ids.tolist(), *columns, strict=True):
                if p != part:
                    close()
                    part, roots, want = p, [], pr
                own = digests[a:z]
                if held[0]:
                    own, c, n = held[0] + own, join(held[1], c, 4 * n), held[2] + n
                if pos[z - 1] != count[z - 1] - 1:
                    held = (own, c, n)
                    continue
                held = ([], 0, 0)
                if n != t or merkle(own) != r:
                    raise ValueError(f"document {d} does not match its root")
                roots.append(r)
                out.append((d, s, n, c))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if held[0]:
            raise ValueError("chunks of the last document are missing")
        close()

    return rows.repartition("part").sortWithinPartitions("part", "start", "pos").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary): every document's ids put together again from the chunks."""
    whole = _positions(spark, path).join(spark.read.schema(CHUNKS).parquet(f"{path}/chunks"), "digest", "left").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    return whole.select("doc_id", "start", F.concat(F.lit(b""), F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).alias("ids"))
