import collections
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystone.llm import ngram_join
from tallystone.llm.common import U64, mix, shingle_sets
from tallystone.llm.ngram_join import Partition, components, ngram_components

from .conftest import texts_of


def brute(rows, k, percent):
    """Set size and component of each id by all shared shingles."""
    sets = collections.defaultdict(list)
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i].append(frozenset(tuple(words[a : a + k]) for a in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else []))
    flat = [(i, s) for i, group in sets.items() for s in group]
    at = collections.defaultdict(list)
    for n, (_, s) in enumerate(flat):
        for t in s:
            at[t].append(n)
    parent = list(range(len(flat)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (_, s) in enumerate(flat):
        for m, both in collections.Counter(m for t in s for m in at[t] if m < n).items():
            if 100 * both >= percent * (len(s) + len(flat[m][1]) - both):
                parent[find(n)] = find(m)
    lowest = {}
    for n, (i, _) in enumerate(flat):
        if i is not None:
            lowest[find(n)] = min(lowest.get(find(n), i), i)
    return sorted((str(i), len(s), str(lowest.get(find(n)) if s else i)) for n, (i, s) in enumerate(flat))


def brute_links(rows, k, percent):
    """Number of other rows that each row links to; all pairs, by their sets."""
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, frozenset(tuple(words[a : a + k]) for a in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])))
    linked = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    return sorted((str(i), sum(bool(linked(s, t)) for m, (_, t) in enumerate(sets) if m != n)) for n, (i, s) in enumerate(sets))


def got_links(df, k, percent):
    return sorted((str(r.doc_id), r.n_links) for r in ngram_components(df, k, percent, count_links=True).collect())


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 5])
def test_numbers_of_links(docs, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    assert got_links(docs, 4, 85) == brute_links(texts_of(docs), 4, 85)
    assert got_links(odd, 4, 85) == brute_links(texts_of(odd), 4, 85)
    assert got_links(odd.limit(0), 4, 85) == []


TWO = {
    "repeated rows beside near copies": [(1, "A"), (1, "A"), (2, "B"), (3, "C")],
    "one id in two groups": [(1, "A"), (5, "A x"), (5, "Z"), (7, "Z y")],
    "one id with two linked texts": [(1, "A"), (1, "A x"), (2, "Z"), (9, "A y")],
    "one id with another text": [(1, "A"), (1, "Z"), (2, "B"), (3, "Z q")],
    "null ids": [(None, "A"), (None, "A"), (4, "A x"), (None, "Z"), (None, "Z y"), (None, "Z y")],
    "ids in falling order": [(9, "A"), (8, "A x"), (7, "A x y"), (3, "Z"), (3, "Z"), (2, "Z z")],
}


def written(rows):
    from .conftest import sentence

    body = {"A": sentence(3, 60), "B": sentence(3, 60) + " end", "C": "start " + sentence(3, 60), "Z": sentence(8, 70)}
    return [(i, " ".join(body.get(w, w) for w in t.split())) for i, t in rows]


@pytest.mark.parametrize("name", sorted(TWO))
def test_ids_with_several_rows(spark, name):
    """Nodes are sets: rows of one id neither link their texts nor count twice."""
    import corpus_pipeline as C

    rows = written(TWO[name])
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        assert got(df, 4, 85) == brute(rows, 4, 85) and got_links(df, 4, 85) == brute_links(rows, 4, 85)
        for c in ("lang", "source", "n_chars"):
            df = df.withColumn(c, F.lit(None).cast("string"))
        kept = [(r.doc_id, r.text) for r in C.near_duplicates(spark, df, None).collect()]
        assert sorted(str(i) for i, _ in kept) == sorted(str(i) for i, _ in heads_of(rows)) and set(kept) <= set(rows)


def test_many_repeats_of_two_near_texts(spark):
    """40,000 rows of two ids take about as long as two."""
    rows = written([(1, "A"), (2, "B")]) * 20_000
    began = time.time()
    out = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, count_links=True).groupBy("doc_id", "component_id", "n_links").count().collect()
    assert sorted(map(tuple, out)) == [(1, 1, 39_999, 20_000), (2, 1, 39_999, 20_000)] and time.time() - began < 90


def test_intersections_of_blocks():
    rng = np.random.default_rng(3)
    for n, m, pool in ((1, 1, 5), (40, 30, 60), (300, 200, 5000), (64, 64, 3000)):
        a, b = ([np.unique(rng.integers(0, pool, rng.integers(1, pool)).astype(U64)) for _ in range(c)] for c in (n, m))
        assert ngram_join.shared(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def heads_of(rows, k=5, percent=80):
    """One (id, text) of each group: of the smallest id, the one whose row the operator would take; wordless texts all, once each."""
    parts = collections.defaultdict(list)
    for i, text in dict.fromkeys(rows):
        parts[i, text] = None
    names = list(parts)
    sets = []
    for _, text in names:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(words[a : a + k]) for a in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else []))
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, s in enumerate(sets):
        for m in range(n):
            if s and sets[m] and 100 * len(s & sets[m]) >= percent * len(s | sets[m]):
                parent[find(n)] = find(m)
    groups = collections.defaultdict(list)
    for n, (i, text) in enumerate(names):
        groups[find(n) if sets[n] else ("own", n)].append((i is None, i, text))
    return [min(g, key=lambda r: (r[0], r[1] or 0, r[2] or ""))[1:] for g in groups.values()]


def got(df, k, percent):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_components(df, k, percent).collect())


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(docs, odd, k, percent):
    assert got(docs, k, percent) == brute(texts_of(docs), k, percent)
    assert got(odd, k, percent) == brute(texts_of(odd), k, percent)
    assert got(odd.limit(0), k, percent) == []


@pytest.mark.parametrize("k", [4, 2])
def test_hot_buckets_are_salted_and_lose_nothing(spark, docs, odd, monkeypatch, k):
    monkeypatch.setattr(ngram_join, "HOT", 2)
    monkeypatch.setattr(ngram_join, "UNEVEN", 1)
    assert got(docs, k, 85) == brute(texts_of(docs), k, 85)
    assert got(odd, k, 85) == brute(texts_of(odd), k, 85)


def test_the_heat_of_all_entries_is_counted():
    rng, part = np.random.default_rng(2), Partition(85)
    for size in (1, 5, 47, 48, 49, 200):
        tokens = np.unique(mix(rng.integers(0, 2**62, size).astype(U64)))
        made = np.concatenate([sig for sig, *_ in part.signatures(tokens, np.zeros(1 << ngram_join.SKETCH_BITS, np.int64))])
        assert (made >> U64(64 - ngram_join.SKETCH_BITS)).astype(np.int64).tolist() == part.all_slots(tokens).tolist()


def test_large_near_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "TOKENS", 500)
    rng = random.Random(5)
    rows = []
    for base in range(3):
        words = [f"w{base}_{i}" for i in range(90)]
        for i in range(40):
            edited = list(words)
            for _ in range(rng.randrange(0, 6)):
                edited[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
            rows.append((base * 1000 + i, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 4, 85) == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_no_pair_within_the_bound_is_missed(percent):
    """Signatures of random pairs at the threshold meet, whatever the sketch says."""
    rng = np.random.default_rng(1)
    part, sketch = Partition(percent), rng.integers(0, 1000, 1 << ngram_join.SKETCH_BITS)
    for _ in range(400):
        size = int(rng.integers(1, 300))
        pool = np.unique(mix(rng.integers(0, 2**62, 3 * size + 8).astype(U64)))
        a = np.sort(pool[:size])
        drop, add = int(rng.integers(0, size // 4 + 1)), int(rng.integers(0, size // 4 + 1))
        b = np.sort(np.concatenate((a[drop:], pool[size : size + add])))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        seen = []
        for tokens in (a, b):
            entries = list(part.signatures(tokens, sketch))
            seen.append({int(s): (bool(p), band, least) for sig, flags, band, least in entries for s, p in zip(sig, flags, strict=True)})
        common = seen[0].keys() & seen[1].keys()
        assert any(seen[0][s][0] or seen[1][s][0] for s in common)
        band = max(int(np.searchsorted(part.hi, len(x))) for x in (a, b))
        here = [s for s in common if seen[0][s][1] == band]
        assert len(here) >= max(seen[n][s][2] for n in (0, 1) for s in here)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(3, 900), (900, 7)], "a long, b long")
    labels = {r.node: r.label for r in components(edges).collect()}
    assert labels == {**{i: 100 for i in range(100, 161)}, 3: 3, 900: 3, 7: 3}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 9])
def test_chunks_of_few_words(k):
    """A chunk of any number of words gives each text the set it has among longer ones."""
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [" ".join("abcdefgh"[:n]) for n in range(9)]
    want = list(shingle_sets(pa.array([*texts, "some longer text of more than nine words in all"]), k))
    for t, w in zip(texts, want, strict=False):
        assert [a.tolist() for a in shingle_sets(pa.array([t]), k)] == [w.tolist()]
        assert list(shingle_sets(pa.array([long, t, long]), k))[1].tolist() == w.tolist()
        assert [a.tolist() for a in shingle_sets(pa.array([t, "", t]), k)] == [w.tolist(), [], w.tolist()]


@pytest.mark.parametrize("words", ["one", "one two", "one two three"])
def test_a_short_document_alone(spark, words):
    df = spark.createDataFrame([(1, words)], "doc_id long, text string").coalesce(1)
    for k in (4, 5):
        assert [tuple(r)[:2] for r in ngram_components(df, k=k, percent=85).select("doc_id", "n_shingles").collect()] == [(1, 1)]


def test_pipeline_stage_keeps_one_of_each_group(spark, docs, odd, sf):
    """The near-duplicate stage against groups by brute force: one row of each stays, of the smallest id."""
    import corpus_pipeline as C

    twice = docs.union(docs.limit(30))
    for df in (twice, odd, odd.limit(0)):
        rows = [tuple(r) for r in df.select(*C.COLUMNS).collect()]
        want = heads_of([(r[0], r[1]) for r in rows])
        kept = [tuple(r) for r in C.near_duplicates(spark, df, sf).collect()]
        assert sorted(str(r[0]) for r in kept) == sorted(str(i) for i, _ in want) and set(kept) <= set(rows)
