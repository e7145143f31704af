"""Profiles and compactions that leave earlier files alone."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallystone.operators import encrypt, integrity, optimize, profile
from tallystone.sources.table import Table


def rows(spark, start, n):
    return spark.range(start, start + n).select("id", (F.col("id") % 5).cast("string").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") / 3).alias("v"), F.array("id").alias("list"))


def files(t):
    return {r.file: r.rows for r in t.stats(t.manifest()).collect()}


def test_a_profile_after_an_append_reads_new_files_only(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(rows(spark, 0, 3000), partition_by=["k"], constraints={"id": {"not_null": True, "min": 0}, "k": {"enum": ["0", "1", "2", "3", "4"]}})
    first = profile.validate(t)
    assert first["rows"] == 3000 and first["columns"]["id"]["distinct_est"] == pytest.approx(3000, rel=0.03)
    old = glob.glob(f"{tmp_path}/t/data/gen-000001/**/*.parquet", recursive=True)
    t.append(rows(spark, 3000, 1000))
    hidden = [(f, f + ".aside") for f in old]
    for a, b in hidden:  # a read of any earlier file would fail
        os.rename(a, b)
    doc = profile.validate(t)
    for a, b in hidden:
        os.rename(b, a)
    whole = {r.column: r for r in profile.profile_frame(t.read()).collect()}
    assert doc["rows"] == 4000 and doc["columns"].keys() == whole.keys()
    for c, r in whole.items():
        mine = doc["columns"][c]
        assert (mine["nulls"], mine["min"], mine["max"], mine["dtype"]) == (r.nulls, r.min, r.max, r.dtype)
        assert mine["distinct_est"] == pytest.approx(r.distinct_est, rel=0.03)
        assert mine["p50"] == pytest.approx(r.p50, rel=0.05) if r.p50 is not None else mine["p50"] is None
    t.append(rows(spark, -50, 10))
    for _ in range(2):  # what has failed is checked again
        with pytest.raises(ValueError, match="id: min broken by 10 rows"):
            profile.validate(t)


def test_sketches_follow_their_files(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(rows(spark, 0, 100).drop("list"))
    profile.validate(t)
    t.write(rows(spark, 500, 40).drop("list"))  # another content
    assert profile.validate(t)["rows"] == 40 and profile.validate(t)["columns"]["id"]["min"] == "500"
    assert profile.validate(t)["columns"]["v"]["nulls"] == 6
    encrypt.encrypt_columns(t, ["v"], "pass phrase", {"n": 2**12, "r": 8, "p": 1})
    left = sorted(os.listdir(tmp_path / "t/meta/index"))
    assert not [n for n in left if n.startswith("sketch-") and f"gen-{n[7:]}" not in os.listdir(tmp_path / "t/data")]  # none of plaintext files that are gone


def test_columns_without_values(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(spark.createDataFrame([(1, None, None), (2, None, float("nan"))], "a int, b double, c double"))
    t.append(spark.createDataFrame([(3, None, 1.5)], "a int, b double, c double"))
    got = {r.column: r for r in profile.profile_table(t).collect()}
    assert (got["b"].nulls, got["b"].p50, got["b"].distinct_est) == (3, None, 0) and (got["c"].nulls, got["c"].p50, got["c"].min) == (2, 1.5, "1.5") and got["a"].p50 == 2


def test_compaction_carries_large_files_over(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(rows(spark, 0, 5000), partition_by=["k"], indexes={"id": {"bloom": {}}})
    for i in range(3):
        t.append(rows(spark, 5000 + 20 * i, 20))
    before, times = files(t), {f: os.path.getmtime(f.removeprefix("file:")) for f in files(t)}
    assert len(before) == 20
    snap = t.list_snapshots()[-1]["ts"]
    out = optimize.optimize(t, target_rows=1500)
    after = files(t)
    assert out["changed"] and set(after) & set(before) == {f for f, n in before.items() if n == 1000} and len(after) == 10
    assert all(os.path.getmtime(f.removeprefix("file:")) == times[f] for f in set(after) & set(before))
    want = sorted(r.id for r in rows(spark, 0, 5060).collect())
    assert sorted(r.id for r in t.read(["id"]).collect()) == want == sorted(r.id for r in t.read(["id"], as_of=snap).collect())
    assert sorted(r.chunk_id for r in t.stats(t.manifest()).collect()) == list(range(10)) and t.manifest()["rows"] == 5060
    assert [r.id for r in t.read(["id"], "id = 5031").collect()] == [5031] and [r.id for r in t.read(["id"], "id = 77").collect()] == [77] and t.plan("id = 77")["count"] < 5
    assert optimize.optimize(t, target_rows=1500) == {"changed": False, "reason": "no_small_chunks"}
    t.append(rows(spark, 9000, 10))
    assert sorted(r.chunk_id for r in t.stats(t.manifest()).collect()) == list(range(15))
    assert optimize.optimize(t, target_rows=1500, whole=True)["changed"] and not set(files(t)) & set(after)
    assert t.read().count() == 5070 and profile.validate(t)["rows"] == 5070


def test_compaction_without_partitions_keeps_rows_in_place(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(rows(spark, 0, 400).repartition(1))
    for i in range(4):
        t.append(rows(spark, 400 + 10 * i, 10).repartition(1))
    optimize.optimize(t, target_rows=500)
    assert sorted(files(t).values()) == [40, 400] and t.read().count() == 440


@pytest.mark.skipif(not os.environ.get("LARGE_FILES"), reason="writes 3 GB")
def test_a_file_beyond_2_gib(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(spark.range(10))
    with open(tmp_path / "t/data/extra.bin", "wb") as f:
        f.truncate(3 << 30)
    got = {r.name: r.bytes for r in integrity.entry_digests(t).collect()}
    assert got["data/extra.bin"] == 3 << 30


def test_z_order_serves_every_column(spark, tmp_path):
    n = 4000
    df = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.when(F.col("id") % 50 != 0, F.concat(F.lit("name"), F.lpad(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("string"), 4, "0"))).alias("b"))
    t = Table(spark, str(tmp_path / "t")).write(df)
    with pytest.raises(ValueError, match="either order or zorder"):
        optimize.optimize(t, order=["a"], zorder=["b"])
    with pytest.raises(ValueError, match="unknown order column"):
        optimize.optimize(t, zorder=["nope"])
    counts = {}
    for name, how in (("lexical", {"order": ["a", "b"]}), ("z", {"zorder": ["a", "id"]})):
        optimize.optimize(t, target_rows=n // 32, **how)
        counts[name] = [t.plan(w)["count"] for w in ("a >= 500 AND a < 520", "id >= 100 AND id < 200")]
        assert sorted(r.id for r in t.read(["id"]).collect()) == list(range(n)) and t.schema().names == ["id", "a", "b"]
    assert counts["z"][1] < counts["lexical"][1] / 2 and counts["z"][0] <= 16
    optimize.optimize(t, target_rows=n // 32, zorder=["b", "a", "id"])
    assert t.read().count() == n and t.read(where="b IS NULL").count() == n // 50
    ranks = df.select(optimize.interleaved(df, ["a"]).alias("z"), "a").groupBy("z").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).orderBy("z").collect()
    assert all(x.hi < y.lo for x, y in zip(ranks, ranks[1:], strict=False)) and len(ranks) > 200


def test_a_snapshot_of_many_files_is_small(spark, tmp_path):
    few = Table(spark, str(tmp_path / "few")).write(spark.range(40).select("id", (F.col("id") % 2).alias("part")), partition_by=["part"])
    many = Table(spark, str(tmp_path / "many")).write(spark.range(40).select("id", F.col("id").alias("part")), partition_by=["part"])
    names = [t.list_snapshots()[-1]["file"] for t in (few, many)]
    sizes = [len(t.store.read_text(f"meta/{n}")) for t, n in zip((few, many), names, strict=True)]
    assert abs(sizes[0] - sizes[1]) < 20 and [t.list_snapshots()[-1]["chunks"] for t in (few, many)] == [2, 40]
    first = many.list_snapshots()[-1]["ts"]
    many.append(spark.createDataFrame([(40, 40)], "id long, part long"))
    found = many.snapshot_files(first).collect()
    assert [r.chunk_id for r in sorted(found)] == list(range(40)) and all("/gen-000001/" in r.path for r in found)
    assert many.snapshot_files("latest").count() == 41 and many.read(as_of=first).count() == 40
