"""Quality classifier, language ID, template removal, top-k search, and the pipeline."""

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystone.llm import common, langid, packing, quality, templates, topk
from tallystone.llm.common import held_out

BIG = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = quality.quality(docs, labels).join(labels, "doc_id").where(held_out()).collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_edges(docs, labels, odd):
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    assert quality.quality(odd.limit(0), labels).count() == 0
    assert quality.quality(odd, labels.limit(0)).select("score").distinct().count() == 1
    both = quality.quality(docs, labels), quality.quality(docs.repartition(7), labels)
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in both)
    assert a == pytest.approx(b, abs=1e-9)


def test_hinge_model_separates():
    rng = np.random.default_rng(0)
    rows, y = [], np.arange(200) % 2
    for label in y:
        rows.append(np.unique(rng.integers(0, 50, 20) + (1000 if label else 2000) * (rng.random(20) < 0.5)))
    w, b, _ = quality.fit(rows, y)
    assert np.mean([(w[r].sum() / np.sqrt(len(r)) + b > 0) == bool(t) for r, t in zip(rows, y, strict=True)]) > 0.97


def test_gradients_of_the_network():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(4)
    h, n, t = 3, 4, 5
    p = {"w": rng.normal(0.4, 0.1, (3 * h, 256)), "u": rng.normal(0, 0.1, (3 * h, h)), "b": rng.normal(0, 0.1, (h, 1))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    x, pull = rng.integers(97, 101, (t, n)).astype(np.uint8), rng.normal(size=(t, h, n)).astype(np.float32)
    _, kept = langid._forward(x, p, True)
    grads = langid._backward(x, kept, pull, p)
    for name, where in (("u", (1, 2)), ("u", (7, 0)), ("w", (0, 98)), ("w", (8, 99)), ("b", (1, 0))):
        ends = []
        for step in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[name][where] += step
            ends.append(float((langid._forward(x, q).astype(np.float64) * pull).sum()))
        assert grads[name][where] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.05, abs=0.02)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = langid.language(docs, keep=("doc_id", "lang")).where(held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(odd):
    rows = langid.language(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {4, 5, 6, 14} and {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    assert langid.language(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<article><h1>A &amp; B</h1><p>one<br>two <b>three<p>four
 five<script>x("<p>")</script> six<div class="share">Share</div><ul><li>i<li>j</ul><form>q</form><div class="box">Follow us</div><section id="comments"><p>bad</p></section></article>
<aside>z</aside><footer>f</footer></body></html>"""


def test_page_text():
    assert templates.page_text(PAGE, frozenset()) == "A & B\n\none two three\n\nfour five\n\nsix\n\ni\n\nj\n\nFollow us"
    for broken in ("", "<", "<p", "</p></div>", "<article>", "a<b>c", "<!-- x", "<script>never ends", "&lt;p&gt; &bogus; &#233;"):
        assert isinstance(templates.page_text(broken, frozenset()), str)
    assert templates.page_text("&lt;p&gt; &#233;", frozenset()) == "<p> é"


def test_templates_are_found_per_host(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("four", f"word{i}")) for i in range(20)] + [(100 + i, f"http://b{i}.example/", PAGE) for i in range(20)] + [(200, None, None), (None, "no url", "<p>x</p>"), (201, "http://a.example/e", "")]
    rows += [(300 + i, "http://c.example/", PAGE) for i in range(20)]  # copies of one page are no template
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: r.text for r in templates.extract(df).collect()}
    assert "Follow us" not in got[3] and "word3" in got[3] and "Follow us" in got[105] and "Follow us" in got[305] and got[200] == "" and got[None] == "x" and got[201] == ""
    assert templates.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [1_000_000, 0])
def test_templates_of_small_and_large_hosts(spark, monkeypatch, pairs):
    """What a page loses doesn't depend on the size of its host, but for hosts with fewer pages than a template needs."""
    monkeypatch.setattr(templates, "BROADCAST_PAIRS", pairs)
    page = "<article><div>{}</div><p>text number {} of the host {}</p></article>"
    rows = [(i, f"http://small.example/{i}", page.format("Read more here", i, "small")) for i in range(4)]
    rows += [(1000 + i, f"http://large.example/{i}", page.format("Section banner" if i % 500 == 0 else f"own {i}", i, "large")) for i in range(2000)]
    rows += [(10 + i, f"http://few.example/{i}", page.format("Three times", i, "few")) for i in range(3)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and [got[i] for i in range(4)] == [f"text number {i} of the host small" for i in range(4)]
    assert all(got[1000 + i] == (f"text number {i} of the host large" if i % 500 == 0 else f"own {i}\n\ntext number {i} of the host large") for i in range(2000))
    assert got[10].startswith("Three times")


def test_deep_pages(spark):
    deep = "<div>" * 20000 + "end"
    assert templates.page_text(deep, frozenset([1])) == "end" and templates.page_hashes(deep)[1] == []
    assert templates.extract(spark.createDataFrame([(1, "http://d.example", deep)], "page_id long, url string, html string")).first().text == "end"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in templates.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def brute_top(rows, every, k):
    own = [(i, np.floor(256 * np.asarray(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids, m = np.array([i for i, _ in own]), np.array([v for _, v in own])
    out = set()
    for i, v in own:
        if i % every == 0:
            s, keep = m @ v, ids != i
            out |= {(i, r + 1, int(ids[keep][x]), int(s[keep][x])) for r, x in enumerate(np.lexsort((ids[keep], -s[keep]))[:k])}
    return sorted(out)


def test_top_k(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = topk.top_k(topk.integer_vectors(table), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top([(r.vec_id, r.embedding) for r in table.collect()], 50, 5)
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "SEEDS", 30)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) * int(rng.integers(1, 4)) for x in (rng.integers(-2, 3, 8) if i % 3 else [1, 1, 0, 0, 0, 0, 0, 1])]) for i in range(700)]
    rows += [(5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit(0)).withColumn("band", F.lit(0))
    assert sorted(map(tuple, topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0).collect())) == brute_top(rows, 50, 5)
    few = df.where("vec_id < 3")
    assert topk.top_k(topk.integer_vectors(few), F.col("vec_id") % 50 == 0).count() == 2
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline(spark, sf, docs, odd, labels):
    import corpus_pipeline as C

    for source in (docs, odd, odd.limit(0)):
        df = source
        for name, stage in C.STAGES:
            before, df = df, C.staged(stage(spark, df, sf), "test")[0]
            if name != C.STAGES[-1][0]:
                assert tuple(df.columns) == C.COLUMNS
                assert df.exceptAll(before.select(*C.COLUMNS)).count() == 0
        assert {"doc_id", "sequence_id", "offset"} <= set(df.columns)
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    kept = C.language_filter(spark, C.quality_filter(spark, docs, sf), sf)
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    once = C.near_duplicates(spark, docs, sf)
    assert C.near_duplicates(spark, once, sf).count() == once.count() < docs.count()


def test_top_k_of_long_vectors_is_exact(spark):
    """Scores beyond 2**53 that differ by less than float64 tells, next to short vectors."""
    rng = np.random.default_rng(1)
    far = [(i, [2**30 + int(x) for x in rng.integers(-40, 40, 2)]) for i in range(60)]
    near = [(100 + i, [int(x) for x in rng.integers(-99, 99, 2)]) for i in range(60)]
    rows = [(i, v, float(np.sqrt(sum(x * x for x in v)))) for i, v in far + near]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>, norm double"), F.lit(True), k=5).collect()
    want = []
    for i, v, _ in rows:
        best = sorted(((sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w, _ in rows if j != i), key=lambda x: (-x[0], x[1]))[:5]
        want += [(i, n + 1, j, s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_query_id_with_two_vectors(spark):
    """The norm belongs to the vector that asks, whichever row comes first."""
    rows = [(1, [1, 0]), (1, [0, 1000]), *((10 + i, [0, 50 + i]) for i in range(30)), *((50 + i, [60 + i, 0]) for i in range(30))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, v, float(np.hypot(*v))) for i, v in order], "vec_id long, v array<long>, norm double").coalesce(1)
        got = topk.top_k(df, F.col("vec_id") == 1, k=3).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(39, 79000), (38, 78000), (37, 77000)]


@pytest.mark.parametrize("big", [1e5, 1e15, 3e38])
def test_top_k_of_vectors_of_any_length(spark, big):
    """Outliers take part as queries and candidates, and are ranked by exact scores, also where these are beyond a long."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, big if i % 7 == 0 else 1, 6).astype(np.float32)]) for i in range(120)]
    rows += [(50, rows[9][1]), (50, rows[9][1]), (7, [float("inf")] * 6), (8, [float("nan")] * 6), (14, None), (None, [1.0] * 6), (15, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(map(tuple, topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 10 == 0).collect()))
    whole = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(map(math.isfinite, v))]
    want, least = [], {}
    for i, v in whole:
        if i % 10 == 0:
            least[i] = min(least.get(i, v), v)
    for i, v in least.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in whole if j != i)[:5]
        want += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_empty_vectors(spark):
    df = spark.createDataFrame([(i, []) for i in range(4)], "vec_id long, embedding array<float>")
    got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") == 0, k=2).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_language_probabilities_by_position():
    """Whole texts through both directions, one position after another."""
    rng = np.random.default_rng(2)
    model = langid.train_network([b"the cat sat on the mat and then", "où est la bibliothèque s'il vous plaît".encode(), b"kurz"], np.asarray([0, 1, 0]), 2, steps=5)
    texts = ["a", "Straße und mehr " * 20, "", "12 34", "x" * 64, "y" * 65, "".join(chr(rng.integers(32, 900)) for _ in range(500)), None]

    def states(window, p):
        h, out = np.zeros(p["u"].shape[1]), []
        n = len(h)
        for c in window:
            x, rec = p["w"][:, c].astype(float), p["u"] @ h
            r, z = np.clip(x[:n] + rec[:n], 0, 1), np.clip(x[n : 2 * n] + rec[n : 2 * n], 0, 1)
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * (rec[2 * n :] + p["b"][:, 0]))
            out.append(h)
        return out

    for text, got in zip(texts, langid.probabilities(pa.array(texts), model), strict=True):
        raw, total, letters = (text or "").encode(), np.zeros(2), 0
        for a in range(0, len(raw), 64):
            window = raw[a : a + 64].ljust(64)
            both = zip(states(window, model["f"]), states(window[::-1], model["r"])[::-1], strict=True)
            for c, (f, b) in zip(raw[a : a + 64], both, strict=False):
                if c >= 128 or chr(c).isalpha():
                    e = np.exp(model["o"]["v"] @ np.concatenate((f, b)) + model["o"]["c"][:, 0])
                    total, letters = total + e / e.sum(), letters + 1
        if any(map(str.isalpha, text or "")):
            assert got == pytest.approx(total / letters, abs=1e-4)
        else:
            assert got is None


def test_language_of_short_texts_and_many_languages(spark):
    """A language of short texts is learned, and none is left out for being one of many."""
    rows = [(i, ["ja nee", "oui non"][i % 2], ["nl", "fr"][i % 2]) for i in range(90)] + [(1000 + i, f"word{i} " * 9, f"l{i:03}") for i in range(0, 900, 2)]
    langs, model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(langs) == 2 + sum(1 for i in range(0, 900, 2) if zlib.crc32(str(1000 + i).encode()) % 3 != 1)
    two = spark.createDataFrame(rows[:90], "doc_id long, text string, lang string")
    got = langid.language(two, keep=("doc_id", "lang")).collect()
    assert all(r.lang_pred == r.lang for r in got)
    # repeated rows change nothing
    a, b = langid.train(two), langid.train(two.union(two).repartition(5))
    assert a[0] == b[0] and all(np.array_equal(a[1][x][y], b[1][x][y]) for x in a[1] for y in a[1][x])


def test_languages_beyond_the_bound(spark, monkeypatch):
    """A dirty lang column doesn't grow what the driver holds: the most frequent languages are learned."""
    monkeypatch.setattr(langid, "MOST_ROWS", 6)
    rows = [(i, f"text of {i % 3}", f"l{i % 3}") for i in range(60)] + [(100 + i, f"junk {i}", f"junk{i}") for i in range(40)]
    langs, _ = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(langs) == 6 and {"l0", "l1", "l2"} <= set(langs)


def test_training_steps_against_a_plain_network():
    """An Adam step, from slopes of the loss that are found one position and one number at a time."""
    texts, labels, n = [b"the cat sat on the mat, all of it", b"le chat est sur le tapis vert et"], np.asarray([0, 1]), 2
    start, batch = langid.train_network(texts, labels, n, steps=0), langid.BATCH
    params = {(a, k): v.astype(float).copy() for a, part in start.items() for k, v in part.items()}
    rng = np.random.default_rng(3)
    h, t = langid.HIDDEN, langid.WINDOW // 2
    for shape in ((3 * h, 256), (3 * h, h)) * 2:
        rng.normal(0, 1, shape)
    rng.normal(0, 1, (n, 2 * h))
    padded = [x.ljust(-(-len(x) // t) * t) for x in texts]

    def loss(p, windows, y):
        total = 0.0
        for w, label in zip(windows, y, strict=True):
            states = []
            for side, order in (("f", w), ("r", w[::-1])):
                s, out = np.zeros(h), []
                for c in order:
                    x, rec = p[side, "w"][:, c], p[side, "u"] @ s
                    r, z = np.clip(x[:h] + rec[:h], 0, 1), np.clip(x[h : 2 * h] + rec[h : 2 * h], 0, 1)
                    s = z * s + (1 - z) * np.tanh(x[2 * h :] + r * (rec[2 * h :] + p[side, "b"][:, 0]))
                    out.append(s)
                states.append(out if side == "f" else out[::-1])
            for f, b in zip(*states, strict=True):
                o = p["o", "v"] @ np.concatenate((f, b)) + p["o", "c"][:, 0]
                total += np.log(np.exp(o - o.max()).sum()) + o.max() - o[label]
        return total / (t * len(windows))

    checked = [("o", "c", (0, 0)), ("o", "v", (1, 3)), ("f", "u", (2, 1)), ("r", "u", (h + 1, 0)), ("f", "b", (3, 0)), ("r", "w", (2 * h + 1, ord("e")))]
    by = [[0], [1]]
    rows = [b[rng.integers(len(b))] for b in by for _ in range(batch // 2)]
    windows = []
    for i in rows:
        at = t * rng.integers(len(padded[i]) // t)
        windows.append(padded[i][at : at + t])
    one = langid.train_network(texts, labels, n, steps=1)
    for a, k, where in checked:
        ends = []
        for e in (1e-4, -1e-4):
            q = {x: v.copy() for x, v in params.items()}
            q[a, k][where] += e
            ends.append(loss(q, windows, labels[rows]))
        slope = (ends[0] - ends[1]) / 2e-4
        rate = 0.03 * min(1.0, 2 * (1 - 1 / 2))
        m, v = 0.1 * slope, 0.01 * slope * slope
        step = rate * (m / 0.1) / (np.sqrt(v / 0.01) + 1e-7)
        if abs(slope) > 1e-4:  # below, rounding decides the first step's direction
            assert one[a][k][where] == pytest.approx(start[a][k][where] - step, abs=2e-4)


def test_quality_features_and_scores_by_hand(spark, odd):
    """Distinct features of single texts are those of the same texts among others, and a score is the sum of its features' weights."""
    texts = ["", None, "one", "Two words", "A b c d e f g a b c d", "x" * 300_000, "rep rep rep rep rep rep", "mixed 12 CASE, é!"]
    together = [sorted(x.tolist()) for x in quality.features(pa.array(texts))]
    assert together == [sorted(next(quality.features(pa.array([t], pa.string()))).tolist()) for t in texts]
    assert [len(x) for x in together[:4]] == [0, 0, 2, 6] and all(len(set(x)) == len(x) for x in together)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "good words here " * 3 if i % 2 else "bad BAD !!!") for i in range(40)] + [(3, "zzz")] * 50, "doc_id long, text string")
    w, b, scale = quality.train(docs, labels)
    got = {r.text: (r.score, r.predicted) for r in quality.quality(docs, labels, keep=("text",)).collect()}
    for text, (score, predicted) in got.items():
        ids = next(quality.features(pa.array([text])))
        want = 1 / (1 + math.exp(-scale * (sum(w[i] for i in ids) / math.sqrt(max(1, len(ids))) + b)))
        assert score == pytest.approx(want) and predicted == int(score >= 0.5)


def test_names_that_clash_are_refused(spark, docs, labels):
    other = docs.withColumn("score", F.lit(1))
    for call in (lambda: quality.quality(other, labels, keep=("doc_id", "score")), lambda: langid.language(other, keep=("score",)), lambda: packing.pack(docs.withColumn("rank", F.lit(1)), 8)):
        with pytest.raises(ValueError, match="named like"):
            call()


def test_a_kept_text_goes_to_python_once(docs, labels, odd):
    from tallystone.llm import toxicity

    for make in (lambda d, keep: quality.quality(d, labels, keep=keep), lambda d, keep: langid.language(d, keep=keep), lambda d, keep: toxicity.toxicity(d, labels, keep=keep)):
        for d in (docs, odd):
            plain, kept = make(d, ("doc_id",)), make(d, ("text", "doc_id"))
            assert "__text" not in kept._jdf.queryExecution().toString() and kept.columns == ["text", *plain.columns]
            assert sorted(map(str, kept.drop("text").collect())) == sorted(map(str, plain.collect()))
            assert sorted(map(str, kept.select("text").collect())) == sorted(map(str, d.select("text").collect()))


def test_stages_hand_texts_to_python_in_small_batches(spark, sf, docs):
    import corpus_pipeline as C

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("some words "), 800).alias("text"))  # 26 MB

    def largest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    def seen():
        return texts.mapInArrow(largest, "bytes long, rows long").agg(F.max("bytes"), F.sum("rows")).first()

    try:
        for _, stage in C.STAGES:
            spark.conf.set(key, before)
            stage(spark, docs.limit(50), sf)
            most, rows = seen()
            assert most < 5 << 20 and rows == 3000
        for set_before, then in (("300k", "300k"), ("1g", "4194304b"), ("5000000", "4194304b")):
            spark.conf.set(key, set_before)
            common.small_batches(spark)
            assert spark.conf.get(key) == then
        spark.conf.set(key, "1g")
        C.run(spark, sf).count()
        assert spark.conf.get(key) == "1g"
    finally:
        spark.conf.set(key, before)
