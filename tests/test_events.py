"""Interval joins, event-time windows, and audit logs that only grow."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tallystone.operators import audit, intervals
from tallystone.sources.table import Table
from tallystone.streaming import windows


@pytest.mark.parametrize("hot", [None, 3])
def test_points_in_intervals(spark, hot):
    rng = random.Random(1)
    points = [(i, rng.choice([rng.uniform(-50, 50), float(rng.randrange(-20, 20)), None, float("nan")])) for i in range(300)] + [(7, 3.0)] * 3
    spans = [(i, a, a + rng.choice([0.0, 0.25, 1.0, 8.0, 300.0, -1.0])) for i in range(120) for a in [float(rng.randrange(-60, 60))]] + [(500, None, 2.0), (501, 1.0, None), (502, 3.0, 4.0), (502, 3.0, 4.0)]
    want = sorted((p, s) for p, x in points for s, a, b in spans if None not in (x, a, b) and a <= x < b)
    got = intervals.interval_join(spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, a double, b double"), "x", "a", "b", hot=hot)
    assert got.columns == ["p", "x", "s", "a", "b"] and sorted((r.p, r.s) for r in got.collect()) == want and len(want) > 1000


@pytest.mark.parametrize("hot", [None, 4])
def test_intervals_that_meet(spark, hot):
    rng, day = random.Random(2), dt.datetime(2024, 1, 1)
    make = lambda n: [(i, a, a + dt.timedelta(minutes=rng.choice([0, 5, 90, 3000, 90_000]))) for i in range(n) for a in [day + dt.timedelta(minutes=rng.randrange(0, 4000))]]
    one, two = make(150), make(150)
    want = sorted((i, j) for i, a, b in one for j, c, d in two if a < b and c < d and c < b and a < d)
    got = intervals.interval_join(spark.createDataFrame(one, "i long, a timestamp_ntz, b timestamp_ntz"), spark.createDataFrame(two, "j long, c timestamp_ntz, d timestamp_ntz"), ("a", "b"), "c", "d", hot=hot)
    assert sorted((r.i, r.j) for r in got.collect()) == want and len(want) > 1000


def test_interval_join_edges(spark):
    a, b = spark.createDataFrame([(1, 2)], "i int, x int"), spark.createDataFrame([(1, 0, 5)], "j int, lo int, hi int")
    assert intervals.interval_join(a, b, "x", "lo", "hi").count() == 1
    assert intervals.interval_join(a, b.limit(0), "x", "lo", "hi").columns == ["i", "x", "j", "lo", "hi"] and intervals.interval_join(a.limit(0), b, "x", "lo", "hi").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        intervals.interval_join(a, b.withColumnRenamed("j", "I"), "x", "lo", "hi")
    with pytest.raises(ValueError, match="no interval of"):
        intervals.interval_join(a.withColumn("x", F.lit("a")), b, "x", "lo", "hi")


def parts(spark, folder, batches):
    for i, rows in enumerate(batches):
        time.sleep(0.05)  # a stream takes files in the order of their times
        spark.createDataFrame(rows, "at timestamp, k string, v long").coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema("at timestamp, k string, v long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.mark.parametrize("how", [{"size": "10 minutes"}, {"size": "10 minutes", "slide": "5 minutes"}, {"size": "4 minutes", "session": True}])
def test_a_stream_with_late_rows_equals_its_batch(spark, tmp_path, how):
    rng, day = random.Random(3), dt.datetime(2024, 1, 1)
    rows = sorted((day + dt.timedelta(seconds=rng.randrange(0, 7200)), rng.choice("ab"), i) for i in range(400)) + [(None, "a", 1)]
    batches = [[] for _ in range(4)]
    for i, r in enumerate(rows):  # some come a batch late, which is within the hour
        batches[min(3, i * 3 // len(rows) + (i % 9 == 0))].append(r)
    batches.append([(day + dt.timedelta(days=2), "end", 0)])
    stream, t = parts(spark, tmp_path / "in", batches), Table(spark, str(tmp_path / "t"))
    measures = {"n": F.count("*"), "total": F.sum("v")}
    for _ in range(2):  # started again, it appends nothing twice
        windows.append_windows(stream, t, str(tmp_path / "c"), "at", keys=["k"], measures=measures, late="1 hour", **how).awaitTermination()
    want = windows.windowed(spark.createDataFrame(rows, "at timestamp, k string, v long"), "at", keys=["k"], measures=measures, **how)
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, want.collect()))


def test_rows_after_their_window_is_final_are_dropped(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    late = [[(day, "a", 1)], [(day + dt.timedelta(hours=5), "a", 2)], [(day + dt.timedelta(hours=6), "a", 4)], [(day + dt.timedelta(minutes=1), "a", 50)], [(day + dt.timedelta(days=1), "end", 0)]]
    t = Table(spark, str(tmp_path / "t"))
    windows.append_windows(parts(spark, tmp_path / "in", late), t, str(tmp_path / "c"), "at", "10 minutes", {"total": F.sum("v")}, late="1 hour").awaitTermination()
    assert sorted(r.total for r in t.read().collect()) == [1, 2, 4]
    with pytest.raises(ValueError, match="slide"):
        windows.windowed(t.read(), "window_start", "1 hour", {}, slide="5 minutes", session=True)


def test_appends_to_the_audit_log_take_no_longer_as_it_grows(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(spark.range(3), auto_snapshot=False)
    took = []
    for block in range(3):
        began = time.time()
        for i in range(150):
            audit.append(t, {"op": "x", "n": i, "text": "y" * 2000}, day="20240101")
        took.append(time.time() - began)
    assert took[2] < 3 * took[0] + 1
    assert audit.verify(t) == {"ok": True, "consistent": True, "files": 1, "events": 450, "signed": 450, "bad": {}}
    assert t.store.last_line("meta/audit/20240101.jsonl", step=10) == t.store.read_text("meta/audit/20240101.jsonl").split("\n")[-2]
    with open(tmp_path / "t/meta/audit/20240101.jsonl", "ab") as f:
        f.write(b'{"cut')  # a writer that died
    audit.append(t, {"op": "y"}, day="20240101")
    assert audit.verify(t)["events"] == 451


def test_few_rows_with_many_pairs_go_to_many_tasks(spark):
    a = spark.range(600).select("id", (F.col("id") * 10).cast("double").alias("x"))
    b = spark.range(600).select(F.col("id").alias("j"), (F.col("id") * 10 - 50).cast("double").alias("lo"), (F.col("id") * 10 + 51).cast("double").alias("hi"))
    got = intervals.interval_join(a, b, "x", "lo", "hi")
    assert got.count() == 600 * 11 - 2 * 15  # from 5 before to 5 behind each
    assert got.groupBy(F.spark_partition_id().alias("task")).count().count() > 8


def shuffled(spark):
    """Rows written to shuffle files so far."""
    g, bus = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def new_rows(spark, before):
    return sum(n for k, n in shuffled(spark).items() if k not in before)


def test_rows_copied_grow_no_faster_than_rows(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PAIRS", 100)
    wrote = []
    for n in (400, 800):  # pairs grow as the square
        a = spark.range(n).select("id", (F.col("id") % 4).cast("double").alias("x"))
        b = spark.range(n).select(F.col("id").alias("j"), (F.col("id") % 2).cast("double").alias("lo"), F.lit(4.0).alias("hi"))
        before = shuffled(spark)
        assert intervals.interval_join(a, b, "x", "lo", "hi").count() == n * n * 7 // 8
        wrote.append(new_rows(spark, before))
    assert wrote[1] < 2.6 * wrote[0]


def test_rows_whose_bin_the_other_side_lacks_are_not_shuffled(spark):
    a = spark.range(20_000).select("id", (F.col("id") % 20 * 100).cast("double").alias("x"))
    b = spark.range(20_000).select(F.col("id").alias("j"), F.when(F.col("id") < 3, 500.0).otherwise(F.col("id") % 20 * 100 + 40.0).alias("lo")).withColumn("hi", F.col("lo") + 1)
    before = shuffled(spark)
    got = intervals.interval_join(a, b, "x", "lo", "hi").select("id", "j").collect()
    assert sorted(map(tuple, got)) == [(i, j) for i in range(5, 20_000, 20) for j in range(3)]
    assert new_rows(spark, before) < 2_000
