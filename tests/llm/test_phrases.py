"""Phrase mining against a plain count, with words that tasks hold and words that are joined."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystone.llm import phrases


def brute(rows, least=10, share=50, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for p, a in cand.items():
        if len(p) == 4:
            for q in ((p[0], *p[1:3]), (p[0], *p[2:4])):
                if 100 * a >= share * cand[q]:
                    gone.add(q)
    by_lang = collections.defaultdict(list)
    for p, a in cand.items():
        if p in gone:
            continue
        cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        by_lang[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, phrase.decode(), -a, left, right, total[lang], -s) for lang, found in by_lang.items() for i, (s, a, phrase, left, right) in enumerate(sorted(found)[:top]))


def texts(seed: int, n: int):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "日本", "x y", "a-b", "İ", "nul\u0000", "z\x1cz"] + [f"w{i}" for i in range(12)]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", ";", " \t "]) for _ in range(rng.randrange(0, 60)))
        out.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), text))
    return out + [(None, None), ("en", ""), ("en", " \t\n"), ("en", "New York City " * 400), ("en", "a b c" * 3000), ("fr", "mot" * 9000), (None, ".,;:!?"), *[("de", "Ja gut so. " * 2)] * 9]


def frame(spark, rows):
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    return df.withColumns({c: F.lit(-1) for c in ("word", "hash", "n", "id", "range", "k0", "ids", "score", "rank", "total")}).repartition(5)


def got(df, **how):
    return sorted(map(tuple, phrases.collocations(df, **how).collect()))


@pytest.mark.parametrize("held", [1 << 21, 6, 0])
def test_against_a_plain_count(spark, monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "ROW", 50)
    monkeypatch.setattr(phrases, "RUN", 300)
    monkeypatch.setattr(phrases, "SPLIT", 700)
    rows = texts(3, 500)
    want = brute(rows)
    assert len(want) > 100 and got(frame(spark, rows)) == want


def test_limits_and_ties(spark):
    rows = texts(5, 300)
    assert got(frame(spark, rows), top=7, least=3, share=30) == brute(rows, 3, 30, 7)
    same = [("en", "b a. d c. é f. ż g.")] * 12  # equal scores and counts: by bytes
    assert got(frame(spark, same)) == brute(same)
    assert [r[2] for r in got(frame(spark, same))] == ["b a", "d c", "é f", "ż g"]


def test_nothing_to_find(spark):
    assert got(frame(spark, texts(1, 3)).limit(0)) == []
    assert got(frame(spark, [("en", "one two three")])) == []


def test_counts_beyond_64_bits(spark):
    """Products of three counts that no long holds."""
    df = spark.createDataFrame([(4 * 10**9, 5 * 10**9, 6 * 10**9), (3, 7, 11), (10**15 - 1, 10**15 - 1, 10**15 - 1)], "a long, l long, r long")
    rows = df.select("a", "l", "r", phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in rows] == [1_000_000 * r.a * r.a // (r.l * r.r) for r in rows]


def test_radix_order_and_runs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 4000):
        a, b = rng.integers(0, 2**62, n).astype(np.uint64) % np.uint64(50) << np.uint64(40), rng.integers(0, 5, n).astype(np.uint32)
        order = phrases.radix_order([a, b])
        assert order.tolist() == np.lexsort((b, a)).tolist()
        columns, times = phrases.run_lengths([a[order], b[order]])
        assert dict(zip(zip(*(c.tolist() for c in columns), strict=True), times.tolist(), strict=True)) == collections.Counter(zip(a.tolist(), b.tolist(), strict=True))


def test_blocks_cut_no_word(monkeypatch):
    monkeypatch.setattr(phrases, "SPLIT", 16)
    words = ["x" * n for n in range(1, 60)]
    langs, column = pa.array(["en"] * 3), pa.array([" ".join(words), "", "tail. end"])
    found = [b[s:e].tobytes().decode() for b, starts, ends, *_ in phrases.split(langs, column) for s, e in zip(starts, ends, strict=True)]
    assert found == [*words, "tail", "end"]
    pieces = np.concatenate([p for *_, p, _ in phrases.split(langs, column)])
    assert len(set(pieces[:-2].tolist())) == 1 and len(set(pieces[-3:].tolist())) == 3
