"""Fingerprints, BPE, licences, packing, token store."""

import hashlib
import textwrap
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallystone.llm import bpe, licenses, packing, token_store
from tallystone.llm.common import bare_units, binary_parts, even_slots, hf_encoder, pieces
from tallystone.llm.fingerprints import edit_report, fingerprints, likeness, shown, winnow

from .conftest import texts_of


def ordered(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.mark.parametrize("w", [1, 3, 4, 7, 16])
def test_winnowing_picks_the_rightmost_least(w):
    text = "abracadabra " * 5 + "a man a plan " * 3
    each = [winnow(text[i : i + 5], 5, w)[0][0] for i in range(len(text) - 4)]
    want = []
    for s in range(max(1, len(each) - w + 1)):
        window = each[s : s + w]
        at = s + max(x for x, y in enumerate(window) if y == min(window))
        if not want or want[-1] != at:
            want.append(at)
    assert winnow(text, 5, w)[1].tolist() == want


def test_shared_passages_leave_a_mark():
    passage = "this passage of text is shared, ok"
    a, b = winnow("first words " + passage + " then", 12, 16), winnow("quite another " + passage + "!", 12, 16)
    assert set(a[0].tolist()) & set(b[0].tolist())


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_edit_report(request, name):
    df = request.getfixturevalue(name)
    rows = ordered(texts_of(df))
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), shown(winnow(t)[0]), shown(winnow(e)[0]), likeness(winnow(t)[0], winnow(e)[0]), likeness(winnow(t)[0], winnow(u)[0])))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in edit_report(df).collect()]
    assert sorted(got) == sorted(want)
    assert edit_report(df.limit(0)).collect() == [] and len(edit_report(df.limit(1)).collect()) == 1
    assert fingerprints(df).where(F.size("hashes") != F.size("positions")).count() == 0


def test_edit_report_keeps_positions(docs):
    for r in edit_report(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        hashes, places = winnow(r.text or "")
        assert r.positions == places.tolist() and r.fingerprint == shown(hashes)


@pytest.mark.parametrize("n", [1, 2, 7, 211])
def test_slots_fill_every_partition_once(spark, n):
    rows = spark.createDataFrame([(s,) for s in even_slots(spark, n)], "slot long").repartition(n, "slot").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == n and all(r[1] == 1 for r in rows)


PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_bpe_round_trip(request, name, library):
    df = request.getfixturevalue(name)
    want = []
    for i, t in texts_of(df):
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH, PATTERN).collect()]
    assert sorted(got) == sorted(want)
    raw = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.raw) for r in raw) == sorted((t or "").encode() for _, t in texts_of(df))
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


TRICKY = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r'sdtmlvre,.!#AéΣß1٣́​ \x85\x1c\x01<|>")), st.characters(exclude_categories=["Cs"])), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(TRICKY, max_size=4))
def test_cached_units_give_the_library_ids(texts):
    import tiktoken
    from tokenizers import Tokenizer

    for file, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        t = Tokenizer.from_file(public_tokenizers.path(file))
        t.encode_special_tokens = True
        assert [t.encode(x, add_special_tokens=False).ids for x in texts] == [a.tolist() for a in hf_encoder(public_tokenizers.path(file), keeps)(texts)]
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    assert [plain.encode_ordinary(x) for x in texts] == [a.tolist() for a in bpe.codec(PATH, PATTERN)[0](texts)]


def test_license_scan(spark, odd):
    name, text = licenses.KNOWN[0]
    rows = [(1, "Copyright (c) 2020 A. B.\n" + text.upper().replace("SUBLICENSE", "SUB-LICENCE")), (2, None), (3, ""), (None, "hello\nall RIGHTS reserved!"), (4, text + " more")]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (name, ""), 2: (None, ""), 3: (None, ""), None: (None, "All-Rights-Reserved"), 4: (None, "")} or got[4][0] is None
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).count() == 0
    plan = licenses.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


def test_licenses_in_any_wrap(spark):
    bodies = [(n, t) for n, t in licenses.KNOWN if n in ("MIT", "ISC") and len(t) > 500]
    rows = [(w * 10 + k, wrapped(t, w), n) for k, (n, t) in enumerate(bodies) for w in range(30, 110)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()
    assert len(got) == len(rows) and {r.doc_id: r.license for r in got} == {i: n for i, _, n in rows}


def test_whole_licenses(spark):
    folder = licenses.license_table.FOLDER
    rows = [(n, "Copyright (c) 2020 A. B.\n\n" + t) for n, t in licenses.license_table.texts(licenses._MIT, licenses._ISC)]
    rows += [(p.stem.split("@")[0], "\r\n".join(("  " + x).upper() for x in p.read_text().split("\n"))) for p in folder.glob("*.txt")]
    bsd = (folder / "BSD-3-Clause.txt").read_text()
    own = bsd.replace("the copyright holder nor", "Acme, Inc. nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "ACME, INC.").replace("THE COPYRIGHT\nHOLDER OR CONTRIBUTORS", "ACME, INC.")
    assert own.count("Acme") == 1 and own.count("ACME") == 2
    rows += [("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2014 Z\n\n{licenses._MIT}"), ("BSD-3-Clause", f"Copyright (c) 2009, Acme\nAll rights reserved.\n\n{own}"), (None, bsd.replace("without\nmodification", "with\nmodification"))]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"} <= {n for n, _ in rows}
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    wrong = [(rows[r.doc_id][0], r.license) for r in got if r.license != rows[r.doc_id][0]]
    assert len(got) == len(rows) and not wrong, wrong


def test_copyright_lines(spark):
    gone = ["Copyright (c) 2020 A. B.", "COPYRIGHT 1999-2001, X", " * Copyright: Ann Other", "(C) 2011 Z", "\u00a9 Z", "Copyright [yyyy] [name of copyright owner]", "Copyright by Z", "(c) Some Body", "(c) Copyright Z"]
    kept = ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE", "copyright license to reproduce", "copyright owner that is granting", "copyright law", "copyright, patent", "Copyright. The"]
    rows = [(f"a\n{t}\n\nz", "a z") for t in gone] + [(f"a\n{t}\nz", None) for t in kept] + [("(a) x\n(b) y\n(c) You must retain", "a x b y c you must retain")]
    for r in spark.createDataFrame(rows, "text string, want string").withColumn("form", licenses.canonical(F.col("text"))).collect():
        assert (r.form == r.want) if r.want else ("copyright" in r.form), r


def test_statements_that_go_on(spark):
    """A statement's further lines go with it, up to an empty line or the licence's own beginning."""
    heads = [
        "Copyright (c) 2020 Bob\nwith his friends", "Copyright (c) 2020 Bob\n   <bob@example.org>,\n   Ann and others", "Copyright and Co. 2019", "Copyright notice Corp 2020", "(c) Bob\nand Ann", "Copyright 2001 A\nCopyright 2002 B\nof two towns",
    ]
    rows = [(i * 10 + k, f"{title}{head}{gap}{licenses._MIT}") for i, head in enumerate(heads) for k, (title, gap) in enumerate((("", "\n\n"), ("MIT License\n\n", "\n\n"), ("", "\n"), ("", "\nAll rights reserved.\n\n")))]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "MIT" for i, _ in rows}
    bsd = (licenses.license_table.FOLDER / "BSD-3-Clause.txt").read_text()
    crowd = ", ".join(f"Contributor Number {i} of the Project" for i in range(60))
    many = bsd.replace("the copyright holder nor", f"{crowd} nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", crowd.upper()).replace("THE COPYRIGHT\nHOLDER OR CONTRIBUTORS", crowd.upper())
    long = "Copyright 2020 A\n" + "line after line\n" * 50_000
    odd = [(1, f"Copyright (c) 2009, {crowd}\n\n{many}"), (1, f"Copyright (c) 2009, {crowd}\n\n{many}"), (2, long), (3, "text " * 300_000)]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("digest", "license", "notices", "form", "line")})
    assert sorted((r.doc_id, r.license) for r in licenses.scan(df).collect() if r.license) == [(1, "BSD-3-Clause")] * 2 and licenses.scan(df).count() == 4
    prose = spark.createDataFrame([("under copyright law\nand so on",), ("Copyright treaty of\nDecember 20, 1996",)], "text string").select(licenses.canonical(F.col("text")).alias("form"))
    assert sorted(r.form for r in prose.collect()) == ["copyright treaty of december 20 1996", "under copyright law and so on"]


def test_scan_against_sql_on_every_known_text(spark, tmp_path):
    """The SQL has the whole list: each known text, with a statement before it, gets its licence from both."""
    import duckdb

    texts = [t for i, (_, t) in enumerate(licenses.KNOWN) if len(t) > 300 or i % 40 == 0]
    rows = [(i, f"Copyright (c) 20{i % 90 + 10} Owner {i}\nand others\n\n{t}" if len(t) > 300 else f"some text\n{t}\nmore text") for i, t in enumerate(texts)] + [(None, None), (5, ""), (6, "Copyright\x01 1999 x\x02\ny\r\n\r\nz © \u2028 é")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(str, (tuple(r) for r in licenses.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect())))
    assert got == sorted(map(str, con.sql(licenses.scan_sql()).fetchall())) and sum("None, ''" not in x for x in got) > 0.95 * len(texts)


def test_notices_of_any_known_text(spark):
    known = [("Beer", "Buy the author a beer."), ("Own", "Non-commercial favour"), ("MIT", "Released under the MIT License.")]
    rows = [(1, "x\n" + "=" * 4000 + " released under the MIT Licence " + "=" * 4000), (2, "buy the AUTHOR a beer!\nnoncommercial favor"), (3, "a beer")]
    got = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {1: "MIT", 2: "Beer,Own", 3: ""}
    assert [r.notices for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), []).collect()] == ["", "", ""]


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 60), st.lists(st.integers(1, 60), max_size=80))
def test_plans_use_each_piece_once(limit, lengths):
    counts = np.bincount([min(n, limit) for n in lengths], minlength=limit + 1)
    used = np.zeros(limit + 1, int)
    for items, bins in packing.plan(counts, limit):
        assert sum(items) <= limit
        for n in items:
            used[n] += bins
    assert (used == counts).all()


def test_best_two():
    counts = np.bincount([3, 4, 4, 7], minlength=20)
    assert packing.best_two(counts, 8, 5) == (4, 4) and packing.best_two(counts, 7, 7) is None
    assert sorted(packing.best_two(counts, 11, 7)) == [4, 7]
    assert packing.best_two(np.bincount([4], minlength=9), 8, 0) is None


@pytest.mark.parametrize(("name", "ranked"), [("docs", 1_000_000), ("docs", 2), ("odd", 1)])
def test_packing(request, monkeypatch, name, ranked):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANKED", ranked)
    monkeypatch.setattr(packing, "PARTS", 3)
    df = request.getfixturevalue(name)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for i, text in texts_of(df):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        ends = list(range(len(ids), 0, -2048))[::-1] if len(ids) > 2048 else [len(ids)]
        for p, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            want.append((str(i), p, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())))
    rows = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    place = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == place.get(r.sequence_id, 0)
        place[r.sequence_id] = r.offset + r.length
    assert max(place.values()) <= 2048 and len(place) <= -(-sum(place.values()) // 2048) + 2
    assert packing.pack_documents(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_crc_join():
    import os

    join = token_store.CrcJoin()
    for n in (0, 1, 7, 1000):
        a, b = os.urandom(n // 2), os.urandom(n)
        assert join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_token_store(request, name, spark, tmp_path):
    from tokenizers import Tokenizer

    df, path = request.getfixturevalue(name), str(tmp_path / "store")
    token_store.write_store(df, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got = sorted(token_store.read_back(spark, path).collect(), key=lambda r: r.start)
    want = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in texts_of(df)]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for i, ids in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id is not None and r.doc_id for r in got] == sorted(r.doc_id is not None and r.doc_id for r in got)
    assert sorted(bytes(r.ids) for r in token_store.read_documents(spark, path).collect()) == sorted(np.asarray(ids, "<u2").tobytes() for _, ids in want)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    chunks.withColumn("ids", F.when(F.col("digest") == F.lit(chunks.first().digest), F.concat("ids", F.lit(b"\0\0"))).otherwise(F.col("ids"))).write.parquet(f"{path}/other")
    token_store.drop_path(spark, f"{path}/chunks")
    spark.read.parquet(f"{path}/other").write.parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="does not match its digest"):
        token_store.read_back(spark, path).collect()


def test_small_letters_as_the_library_makes_them():
    """Every character of the Latin blocks, alone and among others, lower-cased here and by the library."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encoder = hf_encoder(path, keeps_space=False)
    texts = [f"a{chr(c)}B {chr(c)} Z{chr(c)}{chr(c)}. {chr(c)}X" for c in range(0x260)] + ["ΟΔΟΣ İSTANBUL ẞ", "A\u0301É É́", "ÀÉÎÕÜ straßE Ǆǅǆ Ⱥ"]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_bare_units():
    """Units cut by bytes: letters before ASCII punctuation, and runs without white space."""
    import pyarrow as pa

    texts = ["don't stop", "", "  ", "été,x é-é", "a.b.c !a 1,2", "中,x a中,y", "x"]
    units, at = bare_units(*binary_parts(pa.array(texts, pa.large_string())))
    got = [units[a:z].to_pylist() for a, z in zip(at, at[1:], strict=False)]
    assert got == [["don", "'t", "stop"], [], [], ["été", ",x", "é", "-é"], ["a", ".b.c", "!a", "1,2"], ["中,x", "a中,y"], ["x"]]
    units, at = bare_units(*binary_parts(pa.array([], pa.large_string())))
    assert len(units) == 0 and at.tolist() == [0]


def test_long_texts_in_pieces():
    from tokenizers import Tokenizer

    assert list(pieces("ab cd ef", 4)) == ["ab", " cd", " ef"] and list(pieces("abcdefgh ij", 4)) == ["abcdefgh", " ij"] and list(pieces("abcdefgh", 4)) == ["abcdefgh"] and list(pieces("", 4)) == [""]
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["it's, été. ab1 " * 150_000, "x" * 1_100_000 + " y", " " * 1_200_000, "a", "", "q\xa0r"]
    for text, ids in zip(texts, hf_encoder(path, keeps_space=False)(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_store_over_small_batches(spark, odd, tmp_path):
    """Documents whose chunks are spread over several batches."""
    path = str(tmp_path / "store")
    token_store.write_store(odd, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    whole = sorted(map(str, token_store.read_back(spark, path).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, token_store.read_back(spark, path).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_store(spark, odd, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(odd.limit(0), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_store.read_back(spark, path).count() == 0


def test_range_parts(spark):
    from tallystone.llm.common import range_part

    cuts = list(range(0, 5000, 7))
    rows = spark.range(-3, 5003).select("id", range_part(F.col("id"), cuts, "bigint").alias("part"), range_part(F.col("id"), cuts[:50], "bigint").alias("few")).collect()
    assert all(r.part == np.searchsorted(cuts, r.id) and r.few == np.searchsorted(cuts[:50], r.id) for r in rows)
    assert spark.range(1).select(range_part(F.lit(None).cast("long"), cuts, "bigint")).first()[0] == 0


def test_pieces_do_not_depend_on_the_tokenizer_s_cache(spark, sf):
    import public_tokenizers

    from tallystone.llm import common, packing

    docs, path = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas(), public_tokenizers.path("byte_bpe_50k.json")
    common._encoders.pop(path, None)
    few = common.hf_encoder(path, True, 50)
    texts = docs.text.fillna("").tolist()
    ids = [x.tolist() for i in range(0, len(texts), 20) for x in few(texts[i : i + 20])]
    common._encoders.pop(path, None)
    assert len(few.old) > 0 and ids == [x.tolist() for x in common.hf_encoder(path, True, packing.UNITS)(texts)]
    made = packing.pieces(spark.read.parquet(f"{sf}/documents.parquet"), path, 2048, 0, units=50)
    assert made.groupBy("doc_id").sum("length").count() == len(texts)
