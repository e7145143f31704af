"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tallystone.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    def text(v):
        return ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = plain(df.select(*columns).collect())
    if name not in SQL:
        assert rows
        return
    relation = con.sql(SQL[name])
    assert sorted(relation.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows == plain(con.sql(f"SELECT {listed} FROM ({SQL[name]})").fetchall())


def test_file_digests_of_sources_in_several_files(spark, sf, con, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.read.parquet(f"{sf}/documents.parquet").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(key, "4k")  # a source is spread over files, as large ones are
    try:
        rows = plain(QUERIES["file_digests"](spark, str(tmp_path)).select("source", "same", "files").collect())
    finally:
        spark.conf.unset(key)
    assert rows == plain(con.sql(f"SELECT source, same, files FROM ({SQL['file_digests']})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_chains_of_null_payloads_carry_digests_alone(spark, sf, tmp_path):
    from tallystone.plans import catalogue

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("ledger_links", "ledger_chain"):
        got = {r.n: r.linked for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {r.doc_id + 1: r.doc_id % 100 != 50 for r in docs.select("doc_id").collect()}
    runs = catalogue._seals(spark, sf).select(F.lit(0).cast("long").alias("run"), "n", "payload")
    lines = catalogue._chains(runs, one=True)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = next(lines[i + 1] for i, x in enumerate(lines) if "Repartition 1," in x)
    assert "AS digest" in below and "AS payload" not in below  # what the one stream reads
