"""Shared helpers of the training-data operators: staged tables, word hashes, tokenizer cache."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# ---------------------------------------------------------------- staged tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, one of our own in local mode, else an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="tallystone-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files as the query ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, so that lost executors cannot force a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    with shuffles_dropped(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_clash(columns: Iterable[str], *own: str) -> None:
    """Refuse input columns that are named like those an operator adds."""
    if taken := sorted({c.lower() for c in columns} & set(own)):
        raise ValueError(f"columns named like the result's own: {', '.join(taken)}")


def with_text(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``keep`` columns of ``docs`` and, behind them where it isn't one of them, the text; and where it is. A kept text so goes to Python once."""
    return (docs.select(*keep), keep.index("text")) if "text" in keep else (docs.select(*keep, F.col("text").alias("__text")), len(keep))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> str | None:
    """From now on the session hands Python workers Arrow batches of about ``most`` bytes (a longer row comes alone), or of as few as it did before.

    Spark's own bound, 64 MB, is held several times over in each task: by its vectors, by the worker,
    and by both for the rows that come back. Returns the setting so far.
    """
    before = spark.conf.get(_BATCH, None)
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)b?\s*", (before or "-1").lower()).groups()
    if not 0 < int(number) << 10 * "bkmgtp".index(unit or "b") <= most:
        spark.conf.set(_BATCH, f"{most}b")
    return before


@contextlib.contextmanager
def batches_as_before(spark: SparkSession) -> Iterator[None]:
    """Within it, batches are small; then as the session had them."""
    before = small_batches(spark)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def held_out() -> Column:
    """Rows that no model learns from: crc32(doc_id as text) mod 3 = 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Words of 64 bits in a membership bitmap, which is broadcast: 262,144 rows at most.
BITMAP_WORDS = 1 << 18


def _place(column: Column) -> tuple[Column, Column]:
    h = F.xxhash64(column.cast("long"))
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def maybe_among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` with a column ``maybe``: true where ``column`` is one of ``ids`` (its one column), and by chance elsewhere.

    It spares a join the rows that have no partner in a small set of ids. The bitmap has a fixed
    size; the more ids, the more rows are marked by chance, up to all of them.
    """
    word, bit = _place(ids[ids.columns[0]])
    bitmap = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = _place(F.col(column))
    return df.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(bitmap), F.col("_at") == F.col("_word"), "left").withColumn(
        "maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    ).drop("_at", "_bit", "_word", "_bits")


#: Most ranges that a table is cut into; so many numbers reach the driver at most.
MOST_RANGES, _FAN = 16_384, 128


def range_cuts(df: DataFrame, column: str, most: int = MOST_RANGES, every: bool = False) -> list:
    """Quantiles of a numeric column, a range for each shuffle partition (with ``every``, ``most`` ranges); nulls and repeats make fewer."""
    n = max(1, min(most, MOST_RANGES if every else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []


def range_part(column: Column, cuts: list, kind: str) -> Column:
    """Number of the range (cut, next cut] a value is in, found in two steps; 0 for null."""
    if not cuts:
        return F.lit(0)
    every = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    if len(cuts) <= _FAN:
        return F.size(F.filter(every, lambda c: c < column)).cast("int")
    coarse = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[_FAN - 1 :: _FAN]]).cast(f"array<{kind}>"), lambda c: c < column)) * _FAN
    return (coarse + F.size(F.filter(F.slice(every, coarse + 1, _FAN), lambda c: c < column))).cast("int")


def even_slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n shuffle partitions a long that ``repartition(n, column)`` sends there, so that parts dealt by it never meet in one."""
    found = spark.range(n * 24, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("to")).agg(F.min("id").alias("slot")).collect()
    slots = list(range(n))  # for a partition that none of so many numbers goes to
    for r in found:
        slots[r.to] = r.slot
    return slots


# ---------------------------------------------------------------- hashing of words


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


_P = 0x9D39247E33776D41 | 1
_PINV = pow(_P, -1, 1 << 64)
_RAND = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, U64)
        out[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            out[filled : filled + step] = out[:step] * U64(pow(base, filled, 1 << 64))
            filled += step
        _powers[base] = have = out
    return have[:n]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array, nulls as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def byte_chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes stay under ``limit``; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, 64-bit hashes and document numbers of the words of concatenated texts: runs of bytes that aren't ``gaps``, by default ``[^\\x20\\x09-\\x0D]+``."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), z
    solid = ~gaps[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(_RAND[_LOWER[raw] if lower else raw] * powers(_P, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(_PINV, n)[starts]
    hashes = mix(hashes + (ends - starts).astype(U64) * U64(0x8CB92BA72F3D8DD7))
    return starts, ends, hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, no word gives none."""
    raw, offsets = binary_parts(column)
    for i, j in byte_chunks(offsets):
        part = offsets[i : j + 1]
        _, _, h, doc = words_of(raw[part[0] : part[-1]], part - part[0])
        first = np.searchsorted(doc, np.arange(j - i + 1))
        m = len(h)
        full = np.full(m, 0x51ED270B, U64)
        size = np.diff(first)
        short = np.zeros(j - i, U64)
        for step in range(k):
            if step:
                has = size == step
                short[has] = mix(full[first[:-1][has]] + U64(step))
            if step >= m:
                continue  # no k-word shingle in this chunk; short texts still get theirs
            full[: m - step] = mix(full[: m - step] * U64(0xC2B2AE3D27D4EB4F) + h[step:])
        for d in range(j - i):
            if size[d] >= k:
                yield np.unique(full[first[d] : first[d + 1] - k + 1])
            elif size[d]:
                yield short[d : d + 1].copy()
            else:
                yield np.zeros(0, U64)


# ---------------------------------------------------------------- tokenizer cache

#: Latin letters that every split pattern here counts as letters (but \u0130, whose small form ends in a mark that is none), and ASCII punctuation.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", r"!-/:-@\[-`{-~"
_UNIT = re.compile(rf"\s?[{_LETTERS}]+(?=[{_MARKS}\s]|$)|\s*\S+|\s+")
_BARE_UNIT = re.compile(rf"[{_LETTERS}]+(?=[{_MARKS}\s]|$)|\S+")
#: Characters that keep a text from being cut by its bytes: white space beyond ASCII, control characters, and non-letters among the Latin letters.
_BY_CHARACTER = re.compile("[\x01\x1c-\x1f\x85\xa0\xd7\xf7\u0130\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of ASCII letters and of U+00C0 to U+023F, with all that continue a character; ASCII punctuation.
_LETTER_BYTE, _MARK_BYTE = np.zeros(256, bool), np.zeros(256, bool)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
_MARK_BYTE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Control characters that Python alone counts as white space, and the separator below.
_ODD = re.compile("[\x01\x1c-\x1f]")
#: Texts whose capitals have one small letter each, and that no normal form changes.
_LATIN = re.compile("[\\x00-\u012f\u0131-\u024f]*")
_PLAIN_UNIT = re.compile(r"\s?\S")
LONG_UNIT = 96


def bare_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units of concatenated UTF-8 texts, white space left out, and where each text begins among them.

    A unit is a run without white space, or two: the letters it begins with, where ASCII
    punctuation follows them, and the rest. The texts hold none of ``_BY_CHARACTER``.
    """
    n = len(raw)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = solid & edge[:-1], solid & edge[1:]
    first[1:] |= solid[1:] & ~solid[:-1]
    last[:-1] |= solid[:-1] & ~solid[1:]
    first[:1], last[-1:] = solid[:1], solid[-1:]
    begin = np.flatnonzero(first)
    other = np.flatnonzero(solid & ~_LETTER_BYTE[raw])
    run = np.searchsorted(begin, other, "right") - 1
    leads = np.ones(len(other), bool)  # the first byte of its run that is no letter's
    leads[1:] = run[1:] != run[:-1]
    cut = other[leads & _MARK_BYTE[raw[other]] & (other > begin[run])]
    first[cut] = last[cut - 1] = True
    begin = np.flatnonzero(first)
    ends = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - begin))
    units = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw[solid])])
    return units, np.searchsorted(begin, offsets)


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, cut at blanks alone."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(" ", at + 1, at + size)
        if end < 0:
            end = text.find(" ", at + size)
            if end < 0:
                break
        yield text[at:end]
        at = end
    yield text[at:]


class UnitEncoder:
    """Encodes whole texts through a cache of units, each unit once by the tokenizer's own library.

    A text is cut only before white space that follows another character, and between
    a Latin letter and ASCII punctuation. No match of the split patterns used here, nor
    a look-ahead, crosses such a place, so the ids of the units in a row are the ids of
    the text. Texts with characters that Python and the library class differently go
    to the library whole. Two generations of at most ``limit`` units bound the memory.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], token_bytes: np.ndarray | None, dtype: str, limit: int = 600_000):
        self.encode_many, self.token_bytes, self.dtype, self.limit = encode_many, token_bytes, np.dtype(dtype), limit
        self.units = _BARE_UNIT if token_bytes is None else _UNIT
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, self.dtype).tobytes() for ids in self.encode_many(texts)]

    def _encode_units(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Many units in one call, joined by a separator that no match crosses, and told apart again."""
        width = self.dtype.itemsize
        for i in range(0, len(units), 256):
            group = units[i : i + 256]
            if self.token_bytes is None:
                ids = np.asarray(self.encode_many([" \x01 ".join(["", *group, ""])])[0], self.dtype)
                cut = np.flatnonzero(ids == ids[0])
                begin, end = cut[:-1] + 1, cut[1:]
            else:
                plain = [u for u in group if _PLAIN_UNIT.match(u)]
                if len(plain) < len(group):
                    other = [u for u in group if not _PLAIN_UNIT.match(u)]
                    yield from zip(other, self._pack(other), strict=True)
                    group = plain
                if not group:
                    continue
                ids = np.asarray(self.encode_many(["\n" + "\n".join(group)])[0], self.dtype)
                ends = np.cumsum(self.token_bytes[ids])
                last = np.cumsum([len(u.encode()) + 1 for u in group])
                end = np.searchsorted(ends, last) + 1
                begin = np.concatenate(([0], end[:-1])) + 1
            raw = ids.tobytes()
            for u, a, b in zip(group, (begin * width).tolist(), (end * width).tolist(), strict=True):
                yield u, raw[a:b]

    def _known(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units; new ones go to the library and, unless they are long, into the cache."""
        new, old = self.new, self.old
        out = [new.get(u) for u in units]
        ask = []
        for i, ids in enumerate(out):
            if ids is None:
                u = units[i]
                if (ids := old.get(u)) is None:
                    ask.append(u)
                else:
                    new[u] = out[i] = ids
        if ask:
            found = dict(self._encode_units(ask))
            out = [found[u] if ids is None else ids for u, ids in zip(units, out, strict=True)]
            new.update((u, ids) for u, ids in found.items() if len(u) <= LONG_UNIT)
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return out

    def _by_bytes(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without characters of ``_BY_CHARACTER``, by arrays: each distinct unit of some MB is looked up once."""
        parts = [list(pieces(t)) for t in texts]
        raw, offsets = binary_parts(pa.array([p for ps in parts for p in ps], pa.large_string()))
        out: list[np.ndarray] = []
        for i, j in byte_chunks(offsets, 1 << 22):
            part = offsets[i : j + 1]
            units, at = bare_units(raw[part[0] : part[-1]], part - part[0])
            coded = units.dictionary_encode()
            ids = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            where = np.asarray(coded.indices)
            flat = np.frombuffer(b"".join(ids), self.dtype)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
            starts, n = np.cumsum(sizes) - sizes, sizes[where]
            ends = np.append(0, np.cumsum(n))
            stream = flat[np.repeat(starts[where] - ends[:-1], n) + np.arange(ends[-1])]
            bounds = ends[at].tolist()
            out.extend(stream[a:z] for a, z in zip(bounds, bounds[1:], strict=False))
        each = iter(out)
        return [next(each) if len(ps) == 1 else np.concatenate([next(each) for _ in ps]) for ps in parts]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; call it with some MB of texts at a time."""
        if self.token_bytes is not None:
            return self._by_characters(texts)
        texts = [t.lower() if t.isascii() or _LATIN.fullmatch(t) else t for t in texts]  # as the library's normaliser does
        slow = [_BY_CHARACTER.search(t) is not None for t in texts]
        groups = [iter(f([t for t, s in zip(texts, slow, strict=True) if s == k])) for k, f in enumerate((self._by_bytes, self._by_characters))]
        return [next(groups[s]) for s in slow]

    def _by_characters(self, texts: list[str]) -> list[np.ndarray]:
        cuts: list[list[str] | None] = []
        for t in texts:
            cuts.append(None if _ODD.search(t) else self.units.findall(t))
        new, extra = self.new, {}
        if missing := set().union(*[c for c in cuts if c is not None]).difference(new):
            old, ask = self.old, []
            for u in missing:
                ids = old.get(u)
                if ids is None:
                    ask.append(u)
                else:
                    new[u] = ids
            for u, ids in self._encode_units(ask):
                (new if len(u) <= LONG_UNIT else extra)[u] = ids
        out = []
        for t, c in zip(texts, cuts, strict=True):
            if c is None:
                raw = self._pack([t])[0]
            elif extra and any(u in extra for u in c):
                raw = b"".join([extra[u] if u in extra else new[u] for u in c])
            else:
                raw = b"".join(map(new.__getitem__, c))
            out.append(np.frombuffer(raw, self.dtype))
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return out


_encoders: dict[str, UnitEncoder] = {}


def hf_encoder(path: str, keeps_space: bool, limit: int = 600_000) -> UnitEncoder:
    """The worker's encoder for a file of the tokenizers library; special tokens in a text are ordinary text.

    ``keeps_space``: the file is byte level and its tokens spell out the white space.
    """
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        lengths = None
        if keeps_space:
            lengths = np.zeros(t.get_vocab_size(), np.int64)
            for token, i in t.get_vocab().items():
                lengths[i] = len(token)
        _encoders[path] = UnitEncoder(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], lengths, "<u4" if t.get_vocab_size() > 65536 else "<u2", limit)
    return _encoders[path]


def text_chunks(column: pa.Array, limit: int = 1 << 21) -> Iterator[list[str]]:
    """The texts of a string array (null: empty), some MB at a time."""
    column = column.fill_null("")
    _, offsets = binary_parts(column)
    for i, j in byte_chunks(offsets, limit):
        yield column.slice(i, j - i).to_pylist()
