"""Toxicity: held-out accuracy, features and fit against plain forms, and edges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import toxicity
from tallystone.llm.toxicity import BITS, fit, grams, normal, ratios

BIG = "/root/testdata/sf0.1"


def test_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    good = np.asarray([r.score for r in rows if r.toxic == 1])
    bad = np.asarray([r.score for r in rows if r.toxic == 0])
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert len(rows) > 600 and auc > 0.9 and np.mean([r.predicted == r.toxic for r in rows]) > 0.95


def plain(text):
    """Distinct n-grams of the words between blanks, as strings."""
    out = set()
    for word in normal(text).split():
        w = f" {word} "
        out |= {(n, w[i : i + n]) for n in range(3, 7) for i in range(len(w) - n + 1)}
    return out


def test_features_are_the_n_grams_of_words(monkeypatch):
    texts = ["", None, "one", "You IDIOT!", "a b c d", "x" * 3000, "rep rep rep", "Ça é日本語 x́ <|endoftext|>", " \t\n", "!!", "the idiot. The Idiot_idiot", "\ud800 lone"]
    names = {}
    for chunk in (1 << 19, 10):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        rows, ids = grams(texts)
        for i, t in enumerate(texts):
            mine, want = ids[rows == i], plain(t)
            assert len(mine) == len(set(mine.tolist())) == len(want)
            single = grams([t])[1]
            assert sorted(single.tolist()) == sorted(mine.tolist())
        for i, t in enumerate(texts):
            if len(plain(t)) == 1:
                names[next(iter(plain(t)))] = ids[rows == i][0]
    wanted = np.zeros(1 << BITS, bool)
    wanted[grams(["idiot"])[1]] = True
    rows, ids = grams(texts, wanted)
    assert set(rows.tolist()) == {3, 10} and len(ids) == 2 * len(plain("idiot"))


def test_ratios_by_hand():
    counts, texts = np.array([[0, 90, 0, 45, 2], [0, 10, 8, 5, 0.0]]), np.array([90, 10])
    got = ratios(counts, texts)
    assert got[0] == 0 and got[1] == 0 and got[3] == 0 and got[4] == 0  # unseen, in all texts, by chance, rare
    assert got[2] == pytest.approx(np.log((8 + 0.2) / (10 + 0.2)) - np.log(1.8 / (90 + 1.8)))


def test_fit_reaches_the_optimum_of_the_hinge_loss():
    """Dual coordinate descent against many small subgradient steps on the same objective."""
    rng = np.random.default_rng(0)
    ratio = rng.normal(0, 1, 30)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(60)]
    truth = rng.normal(0, 1, 30)
    labels = np.asarray([int(truth[r].sum() + rng.normal(0, 0.5) > 0) for r in rows])
    w, b, _ = fit(rows, labels, ratio, rounds=400)
    x = np.zeros((60, 30))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    x = np.hstack((x, np.ones((60, 1))))
    share = np.asarray([(labels == 0).mean(), (labels == 1).mean()])
    cost, sign = 1 / (2 * share[labels]), np.where(labels == 1, 1.0, -1.0)
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    v, best = np.zeros(31), np.inf
    for t in range(1, 40_000):
        near = sign * (x @ v) < 1
        v = v - (v - (cost * sign * near) @ x) / (t + 50)
        best = min(best, loss(v))
    mine = np.append(np.divide(w, ratio, out=np.zeros(30), where=ratio != 0), b)
    assert loss(mine) <= best * 1.001


def test_planted_words_in_long_and_short_texts(spark):
    rng = np.random.default_rng(1)
    parts = ["the", "er", "an", "tion", "on", "th", "ing", "st"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(int(rng.choice([5, 80, 4000])) if i % 300 < 2 else int(rng.integers(5, 90)))]
        if i % 6 == 0:
            words[int(rng.integers(0, len(words)))] = "Blorg" + word()  # the word's beginning alone tells
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 6 == 0) for r in got)
    # what is held out changes no score
    other = labels.where(~toxicity.held_out()).union(labels.where(toxicity.held_out()).withColumn("toxic", 1 - F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, other).collect()} == pytest.approx({r.doc_id: r.score for r in got})


def test_edges(spark, odd, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {(0.5, 1)}
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0}
    strange = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (1, 0, None), (2, 0, 7)], "doc_id long, quality long, toxic long"))
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (toxicity.toxicity(docs, labels), toxicity.toxicity(docs.repartition(7), strange)))
    assert a == pytest.approx(b, abs=1e-9)
    with pytest.raises(ValueError, match="named like"):
        toxicity.toxicity(docs.withColumn("score", F.lit(1)), labels, keep=("doc_id", "score"))
    assert re.fullmatch(r"(?: \w+)+ ", normal("A, b_c!"))
