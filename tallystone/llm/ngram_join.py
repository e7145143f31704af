"""N-gram Jaccard self-join of texts by universe partitioning and pigeonhole, verified exactly.

A text's set holds the 64-bit hashes of its distinct word k-grams. Two sets of sizes
s <= l with Jaccard >= p/100 differ in at most H = floor((100-p)(s+l)/(100+p)) tokens.
Sizes are grouped in bands; in a band the token universe is hashed into m segments, and
a set's part of a segment is signed by the sum of its tokens' mixed hashes. The larger
set of a pair spends a budget of H+1 over its segments: 1 asks for an equal segment,
2 (small sizes only) also for segments that differ by one deletion. If every segment
missed what was asked of it, the sets would differ in more than H tokens; so no pair is
lost. The budget goes to the cheapest segments, by a count sketch of the signatures of
the whole corpus. Smaller sets are indexed under all segments of their own band and of
the next where a partner can be there.

Candidates meet in signature buckets. Each bucket's most central member leads it; all
buckets of one leader form a group, in which first every member is held against the
leader, then the members that the leader didn't take are held against all others, in
blocks of bounded size. Links are then joined to components by distributed label
propagation. Equal sets are collapsed beforehand, so copies never form pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, drop_path, maybe_among, mix, shingle_sets, staged

#: Slots of the count sketch of all entries, which prices signatures: 8 MB as longs. Tasks write it in pages of so many slots.
SKETCH_BITS, PAGE = 20, 4096
#: Entries of a sketch slot, beyond the median slot's and so many of its standard deviations, above which the slot's buckets are dealt over several tasks.
HOT, UNEVEN = 1_000_000, 16
#: Up to this size sets are also indexed by their one-deletion neighbourhoods.
SMALL = 48
#: Rows and tokens of a block in the exact comparison within a group.
BLOCK, TOKENS = 2048, 4_000_000


def bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Upper set sizes of the bands: steps of a third, from 1."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return np.asarray(out, np.int64)


def segments_of(hi: int, percent: int) -> tuple[int, bool]:
    """Number of segments of a band and whether it has deletion neighbourhoods."""
    most = (100 - percent) * 2 * hi // (100 + percent)
    if hi <= SMALL:
        return most // 2 + 1 + (most > 3), True
    return most + 2 + most // 8, False


class Partition:
    """Signatures of sets for one threshold."""

    def __init__(self, percent: int):
        self.percent, self.hi = percent, bands(percent)

    def contexts(self, size: int) -> list[tuple[int, bool]]:
        """(band, probes) under which a set of this size is signed."""
        b = int(np.searchsorted(self.hi, size))
        out = [(b, True)]
        while (int(self.hi[b]) + 1) * self.percent <= 100 * size:  # a larger partner may be in the next band
            b += 1
            out.append((b, False))
        return out

    def parts(self, tokens: np.ndarray, band: int) -> tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]:
        """m, deletions?, token values, token segments and the signature of each segment."""
        m, deletions = segments_of(int(self.hi[band]), self.percent)
        seg = ((mix(tokens + U64(band * 2 + 1)) >> U64(33)) * U64(m) >> U64(31)).astype(np.int64)
        value = mix(tokens ^ U64(0x5851F42D4C957F2D))
        order = np.argsort(seg, kind="stable")
        total = np.zeros(len(tokens) + 1, U64)
        np.cumsum(value[order], out=total[1:])
        at = np.searchsorted(seg[order], np.arange(m + 1))
        sums = total[at[1:]] - total[at[:-1]]
        return m, deletions, value, seg, sums

    @staticmethod
    def name(sums: np.ndarray, seg: np.ndarray, band: int) -> np.ndarray:
        return mix(sums ^ mix(seg.astype(U64) * U64(0x2545F4914F6CDD1D) + U64(band + 7)))

    def all_slots(self, tokens: np.ndarray) -> np.ndarray:
        """Sketch slots of all entries that a set makes, in the order of ``signatures``."""
        out = []
        for band, _ in self.contexts(len(tokens)):
            m, deletions, value, seg, sums = self.parts(tokens, band)
            out.append(self.name(sums, np.arange(m), band))
            if deletions:
                out.append(self.name(sums[seg] - value, seg, band))
        return (np.concatenate(out) >> U64(64 - SKETCH_BITS)).astype(np.int64)

    def least_equal(self, size: int, band: int) -> int:
        """Of a set's exact signatures in a band, so many at least are those of any one partner: all but the greatest difference."""
        m, deletions = segments_of(int(self.hi[band]), self.percent)
        partner = min(int(self.hi[band]), 100 * size // self.percent)
        return 0 if deletions else m - (100 - self.percent) * (size + partner) // (100 + self.percent)

    def signatures(self, tokens: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, bool | np.ndarray, int, int]]:
        """(signatures, whether they probe, band, least equal ones of a partner) of a set under all its contexts."""
        size = len(tokens)
        for band, probes in self.contexts(size):
            m, deletions, value, seg, sums = self.parts(tokens, band)
            exact = self.name(sums, np.arange(m), band)
            spend = np.zeros(m, np.int64)
            if probes:
                need = (100 - self.percent) * 2 * size // (100 + self.percent) + 1
                sizes = np.bincount(seg, minlength=m)
                price = sketch[(exact >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.float64) + np.where(sizes == 0, 1e9, 1.0 / (1 + sizes))
                if deletions:
                    price = np.concatenate((price, price * 2 + sizes + 1))  # the second unit costs the neighbourhood too
                spend += np.bincount(np.argsort(price, kind="stable")[:need] % m, minlength=m)
            least = self.least_equal(size, band)
            yield exact, spend > 0, band, least
            if deletions:
                yield self.name(sums[seg] - value, seg, band), spend[seg] > 1, band, least


def _arrow(fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip(b, schema.types, strict=True)], schema=schema)

    return run


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set (0, 0 for the empty one)."""
    if not len(tokens):
        return 0, 0
    n = np.full(1, len(tokens), U64)
    a = mix(mix(tokens).sum(keepdims=True) + n)
    b = mix(mix(tokens ^ U64(0xA0761D6478BD642F)).sum(keepdims=True) ^ n)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def packed(counts: np.ndarray) -> bytes:
    """A page of counts in the fewest bytes a count that hold its greatest."""
    top = int(counts.max())
    return counts.astype(f"<u{next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)}").tobytes()


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The sums of the pages of one number, each once."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for page, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if page not in sums:
                sums[page] = np.zeros(PAGE, np.int64)
            sums[page] += np.frombuffer(raw, f"<u{len(raw) // PAGE}").astype(np.int64)
    yield [list(sums), [c.tobytes() for c in sums.values()]]


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit hash of a row's id and text; equal rows have one key."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False, keep_one: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, with ``count_links`` n_links, and with ``keep_one`` row_key and stays.

    Texts link when 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles
    (A-Z lower-cased, words between ASCII white space; shorter texts are one shingle).
    component_id is the smallest id reachable by links, the row's own included. What links are
    sets, each standing for all rows that have it, so rows of one id with different texts are in
    different components unless their texts link, and repeated rows cost no more than one. Rows
    with a null id link like others, but give no component its id: one of such rows alone has
    none. Null or wordless texts have 0 shingles and only themselves. Equal rows are kept as they
    are and link to each other; empty tables give no rows. Texts of any length are taken whole;
    other columns are not looked at. n_links is the number of other rows that a row links to,
    copies included: all sets of a component are compared, block by block, so its cost grows with
    the square of a component's distinct sets; no pair leaves a task. stays is true of one row_key
    in a component, that of a row with the component's id, and of every wordless row.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
    part = Partition(percent)

    # 1. every row's set size and digest, and the sketch of all entries, in one pass over the texts
    def describe(batches):
        heat = np.zeros(1 << SKETCH_BITS, np.int64)
        seen: set[int] = set()
        for b in batches:
            n, keys = [], []
            for tokens in shingle_sets(b.column(1), k):
                key = set_keys(tokens)
                n.append(len(tokens))
                keys.append(key)
                if len(tokens) and key[0] not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key[0])
                    np.add.at(heat, part.all_slots(tokens), 1)
            yield [[None] * len(n), b.column(0), b.column(2), np.asarray(n, np.int64), [x for x, _ in keys], [y for _, y in keys], [None] * len(n)]
        pages = heat.reshape(-1, PAGE)
        used = np.flatnonzero(pages.any(axis=1)).tolist()
        nothing = [None] * len(used)
        yield [used, nothing, nothing, nothing, nothing, nothing, [packed(pages[p]) for p in used]]

    schema = pa.schema([("page", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("counts", pa.binary())])
    both, both_path = staged(base.mapInArrow(_arrow(describe, schema), "page int, id long, row long, n long, k1 long, k2 long, counts binary"), "sets")
    meta = both.where("page is null").select("id", "row", "n", "k1", "k2")
    pages = both.where("page is not null").select("page", "counts").repartition("page").mapInArrow(_arrow(added, pa.schema([("page", pa.int32()), ("counts", pa.binary())])), "page int, counts binary")
    heat = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in pages.collect():  # one row a page, 8 MB at most
        heat[r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.counts, np.int64)
    usual = float(np.median(heat))
    beyond = heat - usual - UNEVEN * np.sqrt(usual)
    spread = np.where(beyond > HOT, beyond // HOT + 1, 1).astype(np.int32)
    sketch_b = spark.sparkContext.broadcast((heat, spread))
    # each set once: its smallest id, its rows, and the row that stands for it, one with that id
    sets_once = meta.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.coalesce(F.min_by("row", "id"), F.min("row")).alias("stands"))

    # 2. signatures; equal sets within a task sign once, and entries of a hot slot are salted by their set
    def sign(batches):
        (table, tasks), seen = sketch_b.value, set()

        def made(sig, *rest):
            sigs, rest = np.concatenate(sig), [np.concatenate(x) for x in rest]
            over = tasks[(sigs >> U64(64 - SKETCH_BITS)).astype(np.int64)]
            return [sigs.view(np.int64), *rest, np.where(over > 1, (mix(rest[0].view(U64)) % over.astype(U64)).astype(np.int32), -1)]

        for b in batches:
            sig, key, probe, band, least = [], [], [], [], []
            for tokens in shingle_sets(b.column(1), k):
                k1 = set_keys(tokens)[0]
                if not len(tokens) or k1 in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(k1)
                for s, p, context, fewest in part.signatures(tokens, table):
                    sig.append(s)
                    probe.append(p)
                    key.append(np.full(len(s), k1, np.int64))
                    band.append(np.full(len(s), context, np.int32))
                    least.append(np.full(len(s), fewest, np.int32))
                if len(sig) >= 1024:
                    yield made(sig, key, probe, band, least)
                    sig, key, probe, band, least = [], [], [], [], []
            if sig:
                yield made(sig, key, probe, band, least)

    schema = pa.schema([("sig", pa.int64()), ("key", pa.int64()), ("probe", pa.bool_()), ("band", pa.int32()), ("least", pa.int32()), ("salt", pa.int32())])
    entries = base.where("text is not null").mapInArrow(_arrow(sign, schema), "sig long, key long, probe boolean, band int, least int, salt int")
    w = Window.partitionBy("sig", "salt")
    met = (
        entries.withColumns({"lo": F.min("key").over(w), "hi": F.max("key").over(w), "any": F.max("probe").over(w), "size": F.count("*").over(w)})
        .where("lo < hi or salt >= 0").select("sig", "key", "size", "any", "band", "least", "salt", "lo", "hi").distinct()
    )
    met, met_path = staged(met, "buckets")
    columns = ("sig", "key", "size", "any", "band", "least")
    cold = met.where("salt < 0").select(*columns)
    if (spread > 1).any():  # the parts of a salted bucket are summed up, few rows each, and the bucket rejoined as a join may split it
        hot = met.where("salt >= 0")
        summed = hot.groupBy("sig", "salt").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("any").alias("any"), F.max("size").alias("size"))
        summed = summed.groupBy("sig").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("any").alias("any"), F.sum("size").alias("size")).where("lo < hi").select("sig", "any", "size")
        met = cold.union(hot.select("sig", "key", "band", "least").join(summed, "sig").select(*columns))
    else:
        met = cold
    # a set that shares fewer signatures than any partner would have with it has none in that band; one deal of the sets serves both windows
    of_band = Window.partitionBy("key", "band")
    shared = met.repartition("key").withColumns({"shared": F.count("*").over(of_band), "fewest": F.max("least").over(of_band)}).where("any and shared >= fewest")
    scored, scored_path = staged(shared.select("sig", "key", F.sum(F.log2("size")).over(Window.partitionBy("key")).alias("score")), "shared")

    # 3. the most central member of each bucket leads it; one group per leader. Leaders are staged, so that the join may split a large bucket.
    leaders, leaders_path = staged(scored.groupBy("sig").agg(F.max(F.struct("score", "key")).alias("top")).select("sig", F.col("top.key").alias("leader")), "leaders")
    groups, groups_path = staged(scored.select("sig", "key").join(leaders, "sig").select("leader", "key").where("leader <> key").distinct(), "groups")

    # 4. the sets of the candidates only, each from the row that stands for it; of repeated rows one is read
    wanted = groups.select("key").union(groups.select("leader")).distinct()
    needed, needed_path = staged(sets_once.join(wanted, sets_once.k1 == wanted.key, "left_semi").select("stands", "k1", "k2"), "needed")

    def tokens_of(batches):
        for b in batches:
            keys, sets = [], []
            for a, c, tokens in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(0), k), strict=True):
                if set_keys(tokens) == (a, c):
                    keys.append(a), sets.append(tokens.tobytes())
            yield [keys, sets]

    schema = pa.schema([("key", pa.int64()), ("tokens", pa.binary())])
    texts = maybe_among(base.select("row", "text"), "row", needed.select("stands")).where("maybe").select("row", "text").dropDuplicates(["row"])
    kept, sets_path = staged(texts.join(needed, F.col("row") == needed.stands).select("text", "k1", "k2").mapInArrow(_arrow(tokens_of, schema), "key long, tokens binary"), "candidates")

    # 5. members against their leader; a group is dealt over as many tasks as it has blocks
    counts, counts_path = staged(groups.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "counts")
    dealt = groups.join(counts, "leader").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = dealt.select("leader", "block", F.lit(1).alias("role"), "key").union(counts.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("leader").alias("key")))
    rows = rows.join(kept, "key").select("leader", "block", "role", "key", "tokens")

    def similar(inter, a, b):
        return 100 * inter >= percent * (a + b - inter)

    def against_leader(batches):
        group, heads = None, []
        for b in batches:
            out = ([], [], [], [])
            for g, blk, role, key, raw in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                tokens = np.frombuffer(raw, U64)
                if (g, blk) != group:
                    group, heads = (g, blk), []
                if role == 0:
                    heads.append(tokens)
                    continue
                hit = any(similar(len(np.intersect1d(tokens, t, assume_unique=True)), len(tokens), len(t)) for t in heads)
                for col, v in zip(out, (g, key, g if hit else None, len(tokens)), strict=True):
                    col.append(v)
            yield list(out)

    schema = pa.schema([("leader", pa.int64()), ("key", pa.int64()), ("linked", pa.int64()), ("n", pa.int64())])
    tried = rows.repartition("leader", "block").sortWithinPartitions("leader", "block", "role").mapInArrow(_arrow(against_leader, schema), "leader long, key long, linked long, n long")
    tried, tried_path = staged(tried, "tried")

    # 6. what the leader did not take, against the rest of its group, block by block
    free = F.col("linked").isNull()
    sizes = tried.groupBy("leader").agg(
        F.sum(free.cast("long")).alias("rest"), F.count("*").alias("all"), F.sum(F.when(free, F.col("n")).otherwise(0)).alias("rest_n"), F.sum("n").alias("all_n")
    )

    def blocks(rows: str, tokens: str):
        return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(tokens) / TOKENS)).cast("int")

    open_groups, open_path = staged(sizes.where("rest > 0 and all > 1").select("leader", blocks("rest", "rest_n").alias("rb"), blocks("all", "all_n").alias("ab")), "open")
    inside = tried.join(open_groups, "leader")
    rest = inside.where("linked is null").select("leader", F.pmod(F.xxhash64("key"), F.col("rb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("j"), F.lit(0).alias("role"), "key", F.lit(None).cast("long").alias("linked"))
    others = inside.select("leader", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("i"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("ab")).cast("int").alias("j"), F.lit(1).alias("role"), "key", "linked")
    pairs = rest.union(others).join(kept, "key").select("leader", "i", "j", "role", "key", "linked", "tokens")

    def links_of(rest_rows, other_rows):
        """A spanning set of the links between two blocks; what the leader took is one class already."""
        keys_, sets_ = [r for r, _, _ in other_rows], [t for _, _, t in other_rows]
        n = len(keys_)
        lengths = np.asarray([len(t) for t in sets_], np.int64)
        flat = np.concatenate(sets_)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(n), lengths)[order]
        parent: dict[int, int] = {}

        def find(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for r, head, _ in other_rows:
            if head is not None and find(r) != find(head):
                parent[find(r)] = find(head)
        for r, _, t in rest_rows:
            a, b = np.searchsorted(flat, t, "left"), np.searchsorted(flat, t, "right")
            span = b - a
            total = int(span.sum())
            if not total:
                continue
            at = np.repeat(a - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(total)
            inter = np.bincount(owner[at], minlength=n)
            for o in np.flatnonzero(100 * inter >= percent * (len(t) + lengths - inter)).tolist():
                x, y = find(r), find(keys_[o])
                if x != y:
                    parent[x] = y
                    yield r, keys_[o]

    def against_rest(batches):
        group, held = None, ([], [])
        for b in batches:
            out = []
            for g, i, j, role, key, linked, raw in zip(*[b.column(c).to_pylist() for c in range(7)], strict=True):
                if (g, i, j) != group:
                    if held[0] and held[1]:
                        out += links_of(*held)
                    group, held = (g, i, j), ([], [])
                held[role].append((key, linked, np.frombuffer(raw, U64)))
            yield [[x for x, _ in out], [y for _, y in out]]
        if held[0] and held[1]:
            out = list(links_of(*held))
            yield [[x for x, _ in out], [y for _, y in out]]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    more = pairs.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(_arrow(against_rest, schema), "a long, b long")
    edges = tried.where("linked is not null").select(F.col("key").alias("a"), F.col("linked").alias("b")).union(more).where("a <> b").distinct()
    edges, edges_path = staged(edges, "links")

    # 7. components, then back to all rows; what is joined to large groups is staged, so that the join may split them
    labels = components(edges)
    parts = sets_once.join(labels, F.col("k1") == labels.node)
    lowest = parts.groupBy("label").agg(F.min("low").alias("lowest"), F.coalesce(F.min_by("k1", "low"), F.min("k1")).alias("head"))
    lowest, lowest_path = staged(lowest.select(F.col("label").alias("of"), "lowest", "head"), "lowest")
    known = sets_once.join(labels, F.col("k1") == labels.node, "left").join(lowest, F.col("label") == lowest.of, "left")
    found = F.col("copies") - 1
    if count_links:
        nodes = parts.select("label", "k1", "copies").join(kept, F.col("k1") == kept.key).select("label", F.col("key").alias("rep"), "copies", "tokens")
        counted, counted_path = staged(links(nodes, percent), "counted")
        known = known.join(counted.select(F.col("rep").alias("linked"), "links"), F.col("k1") == F.col("linked"), "left")
        found = found + F.coalesce("links", F.lit(0))
    first = F.when(F.col("label").isNull() | (F.col("head") == F.col("k1")), F.col("stands"))
    classes, classes_path = staged(known.select("k1", "k2", F.coalesce("lowest", "low").alias("component_id"), found.alias("n_links"), first.alias("stands")), "classes")
    out = meta.join(classes, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []),
        *([F.col("row").alias("row_key"), ((F.col("n") == 0) | F.coalesce(F.col("row") == F.col("stands"), F.lit(False))).alias("stays")] if keep_one else []),
    )
    out, _ = staged(out, "components")
    if count_links:
        drop_path(spark, counted_path)
    drop_path(spark, both_path, met_path, scored_path, leaders_path, groups_path, needed_path, counts_path, open_path, sets_path, tried_path, edges_path, lowest_path, classes_path)
    return out


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``: products of rows for tokens that many hold, counts of meetings for the others."""
    out = np.zeros(len(a) * len(b), np.int64)
    of_a, of_b = np.repeat(np.arange(len(a)), [len(t) for t in a]), np.repeat(np.arange(len(b)), [len(t) for t in b])
    ta, tb = np.concatenate(a), np.concatenate(b)
    order = np.argsort(tb, kind="stable")
    tb, of_b = tb[order], of_b[order]
    lo, span = np.searchsorted(tb, ta, "left"), np.searchsorted(tb, ta, "right")
    span -= lo
    names, at, times = np.unique(ta, return_inverse=True, return_counts=True)
    common = times[at] * span * 200 > len(out)
    column = np.cumsum(np.bincount(at[common], minlength=len(names)) > 0) - 1
    dense = np.argsort(np.where(common, column[at], -1), kind="stable")[int((~common).sum()) :]
    n_dense = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, n_dense, 1024):
        cut = np.searchsorted(column[at[dense]], [c, c + 1024])
        mine = dense[cut[0] : cut[1]]
        x, y = np.zeros((len(a), 1024), np.float32), np.zeros((len(b), 1024), np.float32)
        x[of_a[mine], column[at[mine]] - c] = 1
        once = mine[np.unique(at[mine], return_index=True)[1]]
        rows = np.repeat(lo[once] - np.concatenate(([0], np.cumsum(span[once])[:-1])), span[once]) + np.arange(int(span[once].sum()))
        y[of_b[rows], np.repeat(column[at[once]] - c, span[once])] = 1
        out += (x @ y.T).astype(np.int64).ravel()
    sparse = np.flatnonzero(~common & (span > 0))
    ends = np.cumsum(span[sparse])
    for begin in range(0, int(ends[-1]) if len(ends) else 0, 1 << 22):
        i, j = np.searchsorted(ends, [begin, begin + (1 << 22)], "right")
        mine = sparse[i:j]
        if not len(mine):
            continue
        rows = np.repeat(lo[mine] - np.concatenate(([0], np.cumsum(span[mine])[:-1])), span[mine]) + np.arange(int(span[mine].sum()))
        out += np.bincount(np.repeat(of_a[mine], span[mine]) * len(b) + of_b[rows], minlength=len(out))
    return out.reshape(len(a), len(b))


def links(nodes: DataFrame, percent: int) -> DataFrame:
    """(rep, links): for each set of the components (label, rep, copies, tokens), the rows of other sets that it links to.

    A component is dealt into blocks of bounded rows and tokens, and a task takes two blocks at a time.
    """
    many = nodes.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("tokens")) / (8 * TOKENS))).cast("int").alias("blocks"))
    many, _ = staged(many, "blocks")
    dealt = nodes.join(many, "label").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("role"), "rep", "copies", "tokens")

    def counted(i, j, held):
        sides = [[(rep, copies, np.frombuffer(raw, U64)) for rep, copies, raw in rows] for rows in (held if i != j else held[:1])]
        if not all(sides):
            return
        a, b = sides[0], sides[-1]
        both, la, lb = shared([t for *_, t in a], [t for *_, t in b]), np.asarray([len(t) for *_, t in a]), np.asarray([len(t) for *_, t in b])
        linked = 100 * both >= percent * (la[:, None] + lb[None, :] - both)
        if i == j:
            np.fill_diagonal(linked, False)
        yield from zip([r for r, *_ in a], (linked @ np.asarray([c for _, c, _ in b])).tolist(), strict=True)
        if i != j:
            yield from zip([r for r, *_ in b], (linked.T @ np.asarray([c for _, c, _ in a])).tolist(), strict=True)

    def run(batches):
        group, held = None, ([], [])
        for b in batches:
            out = []
            for label, i, j, role, *row in zip(*[b.column(c).to_pylist() for c in range(7)], strict=True):
                if (label, i, j) != group:
                    if group:
                        out += counted(*group[1:], held)
                    group, held = (label, i, j), ([], [])
                held[role].append(row)
            yield [[x for x, _ in out], [y for _, y in out]]
        out = list(counted(*group[1:], held)) if group else []
        yield [[x for x, _ in out], [y for _, y in out]]

    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64())])
    return dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_arrow(run, schema), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node it is connected with.

    Labels fall by min over neighbours and then by pointer jumping, so the rounds grow with
    the logarithm of a component's diameter; each round is cut off by a written table.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, both_path = staged(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels, path = staged(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        # the old label's node also moves down, which hooks whole trees
        hooks, hooks_path = staged(lower.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("hook")), "hooks")  # so that the join may split a large tree
        moved = lower.join(hooks, lower.node == hooks.root, "left").select("node", "label", F.least("low", "hook").alias("low"))
        moved, moved_path = staged(moved, "hooked")
        up = moved.select(F.col("node").alias("parent"), F.col("low").alias("up"))
        fresh = moved.join(up, moved.low == up.parent, "left").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("changed"))
        fresh, fresh_path = staged(fresh, "labels")
        drop_path(spark, path, hooks_path, moved_path)
        labels, path = fresh.select("node", "label"), fresh_path
        if fresh.where("changed").limit(1).count() == 0:
            drop_path(spark, both_path)
            return labels
