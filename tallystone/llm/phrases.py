"""Phrase collocation mining: exact counts of two- and three-word phrases, and their scores.

Words that are frequent in their language are dictionary-encoded; a phrase with any other
word can't be frequent, so pieces are broken there. The ids of a phrase are packed into a
key of 8 bytes (two words) or 12 (three). Each task sorts the keys of some million words by
radix and writes each distinct one once with its count; Spark deals these runs out by
ranges of keys and sorts them, and equal keys in a row are summed. Three-word phrases are
only counted where a bitmap of the frequent two-word phrases holds both of their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, U64, binary_parts, drop_path, even_slots, mix, staged, words_of

#: Bytes that end a piece, ``[.,;:!?\x0A-\x0D]``, and those between words.
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True

#: Words of the dictionary that tasks hold (8 bytes each): the most frequent ones. Others are joined.
HELD = 1 << 21
#: Bits of the bitmap of frequent two-word phrases (8 MB): however many there are, the bitmap only lets more pass.
PAIR_BITS = 26
#: Bytes of text that are split at once, ids of a coded row, and ids that a task sorts at once.
SPLIT, ROW, RUN = 1 << 20, 1 << 16, 1 << 20
#: Keys that are drawn to cut their ranges.
DRAWN = 200_000
#: Parts in which words that tasks don't hold are numbered.
PARTS = 1024


# ---------------------------------------------------------------- words of texts


def _blocks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SPLIT that cut no word."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + SPLIT)
        stop = int(offsets[np.searchsorted(offsets, end)])  # the next text begins there
        while end < stop:
            gap = np.flatnonzero(_GAP[raw[end : min(end + 4096, stop)]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, stop)
        yield at, end
        at = end


def split(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block: bytes, word starts and ends, 64-bit hashes of (language, word), pieces, and rows of the texts (null: empty)."""
    raw, offsets = binary_parts(texts)
    coded = langs.dictionary_encode()
    of_lang = np.asarray([xxhash.xxh3_64_intdigest(x.encode()) for x in coded.dictionary.to_pylist()], U64)
    salt = of_lang[np.asarray(coded.indices)] if len(langs) else of_lang
    base = 0
    for a, z in _blocks(raw, offsets):
        part = raw[a:z]
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z)] - a
        starts, ends, hashes, _ = words_of(part, np.append(edges, z - a), gaps=_GAP)
        marks = _BREAK[part].astype(np.int64)
        marks[edges] = 1
        piece = np.cumsum(marks) + base
        base = int(piece[-1])
        row = np.searchsorted(offsets, starts + a, "right") - 1
        yield part, starts, ends, mix(hashes ^ salt[row]), piece[starts], row


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in the order they come, and each value's place among them."""
    coded = pa.array(hashes.view(np.int64)).dictionary_encode()
    return np.asarray(coded.dictionary).view(U64), np.asarray(coded.indices)


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    upto = np.append(0, np.cumsum(sizes))
    data = _LOWER[raw[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(data)])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, n) of all words of ``docs`` (lang, text, neither null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, starts, ends, hashes, _, row in split(b.column(0), b.column(1)):
                names, at = _distinct(hashes)
                first = np.zeros(len(names), np.int64)
                first[at[::-1]] = np.arange(len(at))[::-1]
                words = _strings(raw, starts[first], ends[first]).cast(pa.string())
                lang = b.column(0).take(pa.array(row[first])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, words, pa.array(names.view(np.int64)), pa.array(np.bincount(at, minlength=len(names)))], names=["lang", "word", "hash", "n"])

    return docs.mapInArrow(run, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- dictionary and coded pieces


def numbered(frequent: DataFrame) -> tuple[DataFrame, np.ndarray, DataFrame | None]:
    """The words with an id from 1, the sorted hashes that tasks hold (their ids are their places), and the words that they don't hold."""
    spark, n = frequent.sparkSession, frequent.count()
    least = 0 if n <= HELD else frequent.approxQuantile("n", [1 - 0.9 * HELD / n], 0.05 * HELD / n)[0]
    held = np.sort(frequent.where(F.col("n") > least).select("hash").toArrow().column(0).to_numpy())
    if len(held) > 1 and (held[1:] == held[:-1]).any():
        raise ValueError("two words have one 64-bit hash")
    known = spark.sparkContext.broadcast(held)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(known.value, np.asarray(b.column(2)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at + 1)], names=["lang", "word", "hash", "n", "id"])

    words = frequent.where(F.col("n") > least).select("lang", "word", "hash", "n").mapInArrow(place, "lang string, word string, hash long, n long, id long")
    if n == len(held):
        return words, held, None
    rest = frequent.where(F.col("n") <= least).withColumn("part", F.pmod("hash", F.lit(PARTS)).cast("int"))
    first, before = len(held) + 1, {}
    for r in sorted(rest.groupBy("part").count().collect()):  # at most PARTS rows
        before[r.part], first = first, first + r["count"]
    if first >= 1 << 31:
        raise ValueError("more than 2**31 frequent words")
    start = F.element_at(F.array(*[F.lit(before.get(p, 0)) for p in range(PARTS)]), F.col("part") + 1).cast("long")
    rest = rest.select("lang", "word", "hash", "n", (start + F.row_number().over(Window.partitionBy("part").orderBy("hash", "word")) - 1).alias("id"))
    return words.union(rest), held, rest


def _gapped(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Ids with a 0 wherever a piece ends."""
    turn = np.zeros(len(ids), np.int64)
    turn[1:] = piece[1:] != piece[:-1]
    at = np.arange(len(ids)) + np.cumsum(turn)
    out = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.int32)
    out[at] = ids
    return out


def _rows(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of about ROW ids that are cut at a 0 alone, words that no other stands beside left out."""
    edge = np.concatenate(([0], ids, [0]))
    beside = (edge[:-2] > 0) | (edge[2:] > 0)
    ids = np.where(beside, ids, 0)
    keep = ids > 0
    keep[1:] |= ids[:-1] > 0  # one 0 after a run
    ids = ids[keep]
    zeros, at = np.flatnonzero(ids == 0), 0
    while at < len(ids):
        i = np.searchsorted(zeros, at + ROW)
        end = int(zeros[i]) + 1 if i < len(zeros) else len(ids)
        yield ids[at:end]
        at = end


def coded_pieces(docs: DataFrame, held: np.ndarray, rest: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """(ids): the pieces of all texts as 32-bit ids, 0 between them and for words that aren't frequent; and the staged folders."""
    known = docs.sparkSession.sparkContext.broadcast(held)

    def ids_of(hashes: np.ndarray) -> np.ndarray:
        names, at = _distinct(hashes)
        names = names.view(np.int64)
        if not len(known.value):
            return np.zeros(len(hashes), np.int32)
        place = np.minimum(np.searchsorted(known.value, names), len(known.value) - 1)
        return np.where(known.value[place] == names, place + 1, 0).astype(np.int32)[at]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(ids_of(h), piece) for *_, h, piece, _ in split(b.column(0), b.column(1))]
            if parts:
                rows = list(_rows(_gapped(np.concatenate([x for x, _ in parts]), np.concatenate([p for _, p in parts]))))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["ids"])

    if rest is None:
        coded, path = staged(docs.mapInArrow(whole, "ids binary"), "coded")
        return coded, [path]

    def holed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text, with the places and hashes of the words that tasks don't hold."""
        for b in batches:
            parts = [(ids_of(h), h, piece, row) for *_, h, piece, row in split(b.column(0), b.column(1))]
            ids, h, piece, row = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
            cut, out = np.searchsorted(row, np.arange(b.num_rows + 1)), []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if z > a:
                    line = _gapped(np.where(ids[a:z] > 0, ids[a:z], -1), piece[a:z])
                    where = np.flatnonzero(line < 0)
                    out.append((np.maximum(line, 0).tobytes(), where.tolist(), h[a:z][ids[a:z] == 0].view(np.int64).tolist()))
            kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["ids", "at", "hashes"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                line = np.frombuffer(raw, np.int32).copy()
                for x in found or ():
                    line[x["at"]] = x["id"]
                rows += [r.tobytes() for r in _rows(line)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    texts, texts_path = staged(docs.mapInArrow(holed, "ids binary, at array<int>, hashes array<long>").withColumn("text", F.monotonically_increasing_id()), "holed")
    holes = texts.select("text", F.explode(F.arrays_zip("at", "hashes")).alias("x")).select("text", "x.at", F.col("x.hashes").alias("hash"))
    found = holes.join(rest.select("hash", "id"), "hash").groupBy("text").agg(F.collect_list(F.struct("at", "id")).alias("found"))  # bounded by the text
    coded, path = staged(texts.join(found, "text", "left").select("ids", "found").mapInArrow(filled, "ids binary"), "coded")
    return coded, [path, texts_path]


# ---------------------------------------------------------------- sorted runs of keys


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by unsigned columns, first column first: stable passes over 16-bit digits, the last digit first."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        for shift in range(0, c.itemsize * 8, 16):
            digit = (c >> c.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(columns: list[np.ndarray], times: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Each distinct row of sorted columns once, and how often (or the sum of ``times``)."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, n)) if times is None else np.add.reduceat(times, first) if n else times


def _pairs(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64)
    return x[:-1] << 32 | x[1:]


def pair_keys(ids: np.ndarray) -> list[np.ndarray]:
    """Keys of all two-word phrases of a coded row."""
    return [_pairs(ids)[(ids[:-1] > 0) & (ids[1:] > 0)]]


def _bit(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs.view(U64)) >> U64(64 - PAIR_BITS)).astype(np.int64)


def triple_keys(ids: np.ndarray, bitmap: np.ndarray) -> list[np.ndarray]:
    """Keys (first two words, third) of the three-word phrases both of whose pairs the bitmap holds."""
    pairs = _pairs(ids)
    fine = (ids[:-1] > 0) & (ids[1:] > 0)
    at = np.flatnonzero(fine)
    bits = _bit(pairs[at])
    fine[at] = bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 > 0
    both = fine[:-1] & fine[1:]
    return [pairs[:-1][both], ids[2:][both].astype(np.int64)]


def counted(coded: DataFrame, keys_of, width: int, least: int) -> DataFrame:
    """(k0.., n): the keys that come ``least`` times or more, counted over all coded rows."""
    spark = coded.sparkSession
    names = [f"k{i}" for i in range(width)]
    n_ids = coded.agg(F.sum(F.length("ids"))).first()[0] or 0
    rate = min(1.0, 4 * DRAWN / max(1, n_ids))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for raw in b.column(0).to_pylist():
                keys = keys_of(np.frombuffer(raw, np.int32))
                rng = np.random.default_rng(len(keys[0]))
                take = np.flatnonzero(rng.random(len(keys[0])) < rate)
                found.append([k[take] for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in range(width)] if found else [pa.array([], pa.int64())] * width, names=names)

    ddl = ", ".join(f"{x} long" for x in names)
    sample = coded.mapInArrow(drawn, ddl).toArrow()  # about DRAWN rows
    keys = [sample.column(i).to_numpy() for i in range(width)]
    keys = [k[np.lexsort(keys[::-1])] for k in keys]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = np.unique(np.arange(1, parts) * len(keys[0]) // parts) if len(keys[0]) else np.zeros(0, np.int64)
    cuts = [tuple(int(k[i]) for k in keys) for i in at]
    cuts = sorted(set(cuts))
    slots = np.asarray(even_slots(spark, parts), np.int64)[: len(cuts) + 1]  # no two ranges in one task

    def below(columns: list[np.ndarray], cut: tuple[int, ...]) -> int:
        """How many of the sorted rows come before a cut."""
        lo, hi = 0, len(columns[0])
        for c, x in zip(columns, cut, strict=True):
            part = c[lo:hi]
            lo, hi = lo + int(np.searchsorted(part, x, "left")), lo + int(np.searchsorted(part, x, "right"))
        return lo

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([h[i] for h in held]) for i in range(width)]
            order = radix_order([c.view(U64) if i == 0 else c.astype(np.uint32) for i, c in enumerate(columns)])
            columns, n = run_lengths([c[order] for c in columns])
            edges = [0, *[below(columns, cut) for cut in cuts], len(n)]
            ranges = np.repeat(slots, np.diff(edges))
            for i in range(0, len(n), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (ranges, *columns, n)], names=["range", *names, "n"])

        for b in batches:
            for raw in b.column(0).to_pylist():
                keys = keys_of(np.frombuffer(raw, np.int32))
                held.append(keys)
                size += len(keys[0])
                if size >= RUN:
                    yield from made()
                    held, size = [], 0
        if size:
            yield from made()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last key's columns and count, which the next batch may go on with

        def kept(columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            fine = n >= least
            return pa.RecordBatch.from_arrays([pa.array(x[fine], pa.int64()) for x in (*columns, n)], names=[*names, "n"])

        for b in batches:
            if not b.num_rows:
                continue
            columns, n = [np.asarray(b.column(i)) for i in range(width)], np.asarray(b.column(width))
            if last is not None:
                columns, n = [np.append(x, c) for x, c in zip(last[0], columns, strict=True)], np.append(last[1], n)
            columns, n = run_lengths(columns, n)
            last = ([c[-1:] for c in columns], n[-1:])
            yield kept([c[:-1] for c in columns], n[:-1])
        if last is not None:
            yield kept(*last)

    dealt = coded.mapInArrow(runs, f"range long, {ddl}, n long").repartition(parts, "range").sortWithinPartitions(*names)
    return dealt.select(*names, "n").mapInArrow(summed, f"{ddl}, n long")


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """Bits of the two-word phrases, 2**PAIR_BITS in all."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _bit(np.ascontiguousarray(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((U64(1) << (bits & 63).astype(U64)).view(np.int64))], names=["at", "bits"])

    got = pairs.select("k0").mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**20 rows at most
    out = np.zeros(1 << (PAIR_BITS - 6), np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.view(np.uint8)


# ---------------------------------------------------------------- scores


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals, exact while counts are below 10**15."""
    wide = [c.cast("decimal(16,0)") for c in (a, left, right)]
    return F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0]).cast("decimal(31,0)")), wide[1] * wide[2])


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score, all numbers long.

    Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
    ``[^\\x20\\x09]+``. A phrase counts where it comes ``least`` times (a) or more; l and r are the counts
    of the two parts of its lowest-scoring cut (the earliest of equal ones), n the language's words.
    A phrase goes if a longer one that holds it has ``share`` percent of its count. Ties go to the greater
    a, then to the smaller phrase by bytes. Null texts are empty, null languages ``und``; every row
    counts, repeated ones too; texts of any length are read whole; other columns are not looked at; an
    empty table gives no rows. Words are told apart by 64-bit hashes while they are counted in phrases.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, counts_path = staged(word_counts(base), "words")
    totals, totals_path = staged(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words, held, rest = numbered(counts.where(F.col("n") >= least))
    words, words_path = staged(words.select("id", "lang", "word", "hash", "n"), "dictionary")
    if rest is not None:
        rest = words.where(F.col("id") > len(held))
    coded, coded_paths = coded_pieces(base, held, rest)
    drop_path(spark, counts_path, *coded_paths[1:])
    pairs, pairs_path = staged(counted(coded, pair_keys, 1, least), "pairs")
    bitmap = spark.sparkContext.broadcast(pair_bitmap(pairs))
    triples, triples_path = staged(counted(coded, lambda ids: triple_keys(ids, bitmap.value), 2, least), "triples")
    drop_path(spark, coded_paths[0])

    def first(key: str) -> Column:
        return F.shiftright(key, 32)

    def second(key: str) -> Column:
        return F.col(key).bitwiseAND(F.lit((1 << 32) - 1))

    def word(name: str, *more: str) -> DataFrame:
        return words.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), *more)

    two = pairs.select("k0", first("k0").alias("w0"), second("k0").alias("w1"), F.lit(None).cast("long").alias("w2"), F.col("n").alias("a"))
    two = two.join(word("w0", "lang"), "w0").join(word("w1"), "w1")
    longer = triples.select("k0", "n").union(triples.select(F.call_function("shiftleft", second("k0"), F.lit(32)).bitwiseOR(F.col("k1")), "n")).groupBy("k0").agg(F.max("n").alias("longer"))
    two = two.join(longer, "k0", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    two = two.select("lang", "w0", "w1", "w2", "a", F.col("w0_n").alias("l"), F.col("w1_n").alias("r"), _score(F.col("a"), F.col("w0_n"), F.col("w1_n")).alias("score"))
    three = triples.select("k0", first("k0").alias("w0"), second("k0").alias("w1"), F.col("k1").alias("w2"), F.call_function("shiftleft", second("k0"), F.lit(32)).bitwiseOR(F.col("k1")).alias("last"), F.col("n").alias("a"))
    three = three.join(word("w0", "lang"), "w0").join(word("w2"), "w2").join(pairs.select("k0", F.col("n").alias("head_n")), "k0").join(pairs.select(F.col("k0").alias("last"), F.col("n").alias("last_n")), "last")
    three = three.withColumns({"s1": _score(F.col("a"), F.col("w0_n"), F.col("last_n")), "s2": _score(F.col("a"), F.col("head_n"), F.col("w2_n"))})
    late = F.col("s2") < F.col("s1")
    three = three.select(
        "lang", "w0", "w1", "w2", "a", F.when(late, F.col("head_n")).otherwise(F.col("w0_n")).alias("l"), F.when(late, F.col("w2_n")).otherwise(F.col("last_n")).alias("r"), F.least("s1", "s2").alias("score")
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # phrases are spelled out only where they may be among the first, ties included
    both = two.union(three).withColumn("part", F.pmod(F.xxhash64("w0", "w1", "w2"), F.lit(64)))  # a part's first ones hold the language's first ones
    both = both.withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    near, near_path = staged(both.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place", "part"), "best")

    def spelled(i: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"))

    near = near.join(spelled(0), "w0").join(spelled(1), "w1").join(spelled(2), "w2", "left").withColumn("phrase", F.concat_ws(" ", "t0", "t1", "t2"))
    ranked = near.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    out, _ = staged(out, "phrases")
    drop_path(spark, totals_path, words_path, pairs_path, triples_path, near_path)
    return out


def collocations_sql() -> str:
    """The same for DuckDB, with the defaults."""
    return """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lines AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS p FROM lines, (SELECT unnest([1, 2, 3])::BIGINT AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lines GROUP BY lang),
cuts AS (SELECT lang, k, p, a, string_split(p, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
parts AS (SELECT c.*, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.p = array_to_string(c.w[1 : c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.p = array_to_string(c.w[c.cut + 1 :], ' ')),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inner_pairs AS (SELECT lang, unnest([array_to_string(string_split(p, ' ')[1 : 2], ' '), array_to_string(string_split(p, ' ')[2 : 3], ' ')]) AS p, a FROM f WHERE k = 3),
longer AS (SELECT lang, p, max(a) AS a FROM inner_pairs GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN longer g ON g.lang = c.lang AND g.p = c.p AND c.k = 2 WHERE g.a IS NULL OR 100 * g.a < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank FROM kept)
SELECT c.lang, c.rank, c.p AS phrase, c.a, c.l, c.r, t.n, c.score FROM ranked c JOIN totals t USING (lang) WHERE c.rank <= 2000"""
