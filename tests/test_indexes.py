"""Index kinds that a table's planner asks: trigram bitmaps, and one that a user registers."""

import random

import pytest
from pyspark.sql import functions as F

from tallystone.functions import registry
from tallystone.operators import encrypt, optimize
from tallystone.sources.table import Table

WORDS = ["harbour", "orchard", "glacier", "Zürich", "a😀b😀c"]


def texts(spark, n=60):
    name = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("id") % 5 + 1).cast("int"))
    return spark.range(n).select("id", (F.col("id") % 5).alias("part"), F.when(F.col("id") != 7, F.concat_ws(" ", F.lit("the"), name, F.col("id").cast("string"))).alias("note"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t")).write(texts(spark), partition_by=["part"], indexes={"note": {"trigrams": {}}})


def files(table, where, **how):
    return table.plan(where, **how)["candidates_count"]


def test_trigrams_prune_and_lose_nothing(spark, table):
    assert files(table, "note CONTAINS 'rchar'") == 1 and files(table, "note CONTAINS 'the'") == 5 and files(table, "note CONTAINS 'nowhere at all'") == 0
    assert files(table, "note CONTAINS 'ürich'") == 1 and files(table, "note CONTAINS '😀b😀'") == 1
    assert files(table, "note CONTAINS 'rchar' OR note CONTAINS 'glaci'") == 2 and files(table, "note CONTAINS 'rchar' AND note CONTAINS 'glaci'") == 0
    assert files(table, "note CONTAINS 'rchar' OR part = 3") == 2
    assert files(table, "note = 'the orchard 1'") == 1 and files(table, "note IN ('the orchard 1', 'the glacier 2')") == 2
    assert files(table, "NOT note CONTAINS 'rchar'") == 5  # says nothing of the rows that don't hold it
    plain = texts(spark)
    for word in ("rchar", "ürich", "😀b😀", "e", "", "the", "1", "%", "harbour 5", "nowhere at all"):
        for where, want in ((f"note CONTAINS '{word}'", F.col("note").contains(word)), (f"note NOT CONTAINS '{word}' AND id > 3", ~F.col("note").contains(word) & (F.col("id") > 3))):
            assert rows(table.read(where=where)) == rows(plain.where(want)), where
    assert table.plan("note CONTAINS 'rchar'")["indexes"]["trigrams"] == {"n_chunks_indexed": 5}


def test_trigrams_after_appends_compaction_snapshots_and_encryption(spark, table, monkeypatch):
    first = table.list_snapshots()[-1]["ts"]
    table.append(spark.createDataFrame([(100, 1, "a quiet meadow"), (101, 9, None), (102, 9, "ab")], "id long, part long, note string"))
    assert files(table, "note CONTAINS 'meadow'") <= 2 and rows(table.read(["id"], "note CONTAINS 'meadow'")) == [(100,)]
    assert files(table, "note CONTAINS 'meadow'", as_of=first) == 0
    optimize.optimize(table, target_rows=20)
    assert rows(table.read(["id"], "note CONTAINS 'meadow'")) == [(100,)] and files(table, "note CONTAINS 'rchar'") == 1
    optimize.reindex(table, {"note": {"trigrams": {"bits": 64}}})  # so few bits that all are set: nothing is pruned, nothing lost
    assert rows(table.read(["id"], "note CONTAINS 'meadow'")) == [(100,)]
    monkeypatch.setattr("tallystone.sources.table.MANY_COMMITS", 1)
    table.append(spark.createDataFrame([(103, 3, "a stony brook")], "id long, part long, note string"))
    table.append(spark.createDataFrame([(104, 3, "a stony ridge")], "id long, part long, note string"))
    assert rows(table.read(["id"], "note CONTAINS 'stony'")) == [(103,), (104,)] and files(table, "note CONTAINS 'brook'") < files(table, None)
    encrypt.encrypt_columns(table, ["note"], "pw", {"n": 2**10, "r": 8, "p": 1})
    assert not table.manifest()["kinds"] and rows(table.read(["id"], "note CONTAINS 'stony'", passphrase="pw")) == [(103,), (104,)]


def test_trigrams_of_any_text(spark, tmp_path, monkeypatch):
    """The runs of three characters, not of halves of characters, of all texts, however long, and none across two texts."""
    monkeypatch.setattr(registry, "MANY_CHARACTERS", 50)
    rng = random.Random(3)
    notes = ["".join(rng.choices("aäb€😀\0\ufffd \n", k=n)) for n in [*range(8), 47, 48, 49, 50, 51, 52, 53, 99, 100, 101, 102, 500]] * 2
    raw = [*(x.encode() for x in notes), None, b"ab\xff\xf0\x9fcde\x80"]
    want = {x[i : i + 3] for x in [*notes, raw[-1].decode("utf-8", "replace")] for i in range(len(x) - 2)}
    got = list(registry.distinct_grams(iter(raw)))
    assert set().union(*got) == want and all(len(g) == len(set(g)) for g in got) and list(registry.distinct_grams(iter([b"ab", None, b"", b"cd"]))) == []
    t = Table(spark, str(tmp_path / "t")).write(spark.createDataFrame([(i % 2, "😀bc" if i % 2 else "a") for i in range(20)], "part int, note string"), partition_by=["part"], indexes={"note": {"trigrams": {}}})
    bits = [sum((w & (1 << 64) - 1).bit_count() for w in (r.words or {}).values()) for r in t.kind_rows(t.manifest(), "trigrams").collect()]
    assert sorted(bits) == [0, 1] and files(t, "note CONTAINS '😀bc'") == 1 and rows(t.read(["part"], "note CONTAINS 'bc'")) == [(1,)] * 10


def test_a_kind_of_the_users_own(spark, tmp_path):
    def build(data, column):
        return data.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.collect_set(F.col(column) % 10).alias("ends"))

    registry.register("last_digit", registry.IndexKind(build, lambda op, v: F.array_contains("ends", v % 10) if op == "=" else F.lit(True)))
    df = spark.range(100).select("id", (F.col("id") % 10 % 4).alias("part"))
    t = Table(spark, str(tmp_path / "t")).write(df, partition_by=["part"], indexes={"id": {"last_digit": {}}})
    assert files(t, "id = 17") == 1 and files(t, "id IN (17, 18)") == 2 and files(t, "id > 17") == 4 and files(t, "id BETWEEN 17 AND 18") == 4
    assert rows(t.read(["id"], "id IN (17, 18)")) == [(17,), (18,)]
    del registry._KINDS["last_digit"]  # a reader without the kind
    assert files(t, "id = 17") == 4 and rows(t.read(["id"], "id = 17")) == [(17,)]
    with pytest.raises(KeyError, match="no index kind"):
        Table(spark, str(tmp_path / "u")).write(df, indexes={"id": {"unheard": {}}})


def test_an_empty_table_with_trigrams(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(texts(spark, 0), partition_by=["part"], indexes={"note": {"trigrams": {}}})
    assert t.read(where="note CONTAINS 'harbour'").count() == 0
