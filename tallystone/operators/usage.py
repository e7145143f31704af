"""Usage records: aggregates, key figures, and layout advice."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import order_statistics

if TYPE_CHECKING:
    from ..sources.table import Table

SCHEMA = "ts string, where string, columns array<string>, bytes_read long, chunks_scanned long, as_of string"
EQUAL = r"(?i)\b([A-Za-z_]\w*)\s*(?:==|=)\s*(?:'[^']*'|\"[^\"]*\"|[^\s()<>=!]+)"
RANGE = r"(?i)\b([A-Za-z_]\w*)\s*(?:>=|<=|>|<)"
BETWEEN = r"(?i)\b([A-Za-z_]\w*)\s+BETWEEN\b"
IN = r"(?i)\b([A-Za-z_]\w*)\s+IN\s*\(([^)]*)\)"


def records(table: Table) -> DataFrame:
    """The usage log; lines that aren't JSON are dropped."""
    if not table.store.names("meta/usage"):
        return table.spark.createDataFrame([], SCHEMA)
    raw = table.spark.read.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{table.path}/meta/usage/*.json")
    return raw.withColumn("bad", F.col("_bad").isNotNull()).where("not bad").drop("bad", "_bad")


def nearest_rank(p: float):
    """Place round_half_even(p / 100 * (n - 1)) of n sorted values."""
    return lambda n: F.bround(F.lit(p / 100) * (n - 1))


def figures(log: DataFrame, bytes_col: str = "bytes_read", chunks_col: str = "chunks_scanned") -> DataFrame:
    """One row: reads_total, bytes_read_total, chunks_scanned_total and nearest-rank p50/p95 of both."""
    sums = log.agg(
        F.lit(0).alias("one"), F.count("*").alias("reads_total"), F.coalesce(F.sum(bytes_col), F.lit(0)).cast("long").alias("bytes_read_total"), F.coalesce(F.sum(chunks_col), F.lit(0)).cast("long").alias("chunks_scanned_total")
    )
    for c, name in ((bytes_col, "bytes"), (chunks_col, "chunks")):
        ranks = order_statistics(log, [], c, {f"{name}_p{p}": nearest_rank(p) for p in (50, 95)})
        sums = sums.join(ranks.drop("n").withColumn("one", F.lit(0)), "one", "left")  # a row beside a row
    return sums.drop("one")


def difference(pre: dict[str, Any], now: dict[str, Any]) -> dict[str, Any]:
    """How figures moved, where both are known."""
    return {k: now[k] - pre[k] for k in now if pre.get(k) is not None and now[k] is not None}


def kpis(table: Table, window: int | None = None) -> dict[str, Any]:
    """Key figures over the whole log, or its last ``window`` records; {} when there are none."""
    log = records(table)
    row = figures(log.orderBy(F.desc("ts")).limit(window) if window else log).first()
    return row.asDict() if row.reads_total else {}


def top(log: DataFrame, column: Column, order: str, n: int = 10) -> DataFrame:
    """(value, count): the n most frequent values, the first seen of equals."""
    return log.select(column.alias("value"), order).where("value is not null").groupBy("value").agg(F.count("*").alias("count"), F.min(order).alias("first")).orderBy(F.desc("count"), "first", "value").limit(n).select("value", "count")


def aggregate(table: Table, limit: int = 1000) -> dict[str, Any]:
    """Sums, interpolated percentiles and top-10 lists of the last ``limit`` records; stored in the profiles."""
    log = records(table).orderBy(F.desc("ts")).limit(limit)
    one = log.agg(
        F.count("*").alias("reads"), F.sum("bytes_read").alias("bytes_total"), F.sum("chunks_scanned").alias("chunks_total"),
        *[F.percentile(c, F.lit(p / 100)).alias(f"{a}_p{p}") for c, a in (("bytes_read", "bytes"), ("chunks_scanned", "chunks")) for p in (50, 95)],
    ).first()
    doc = one.asDict() | {
        "top_columns": [[r[0], r[1]] for r in top(log.select("ts", F.explode("columns").alias("c")), F.col("c"), "ts").collect()],
        "top_where": [[r[0], r[1]] for r in top(log, F.col("where"), "ts").collect()],
    }
    table.store.write_json("meta/profiles/usage.json", doc)
    return doc


def update_kpis(table: Table, baseline: bool = False, window: int | None = None) -> dict[str, Any]:
    """Store the present figures (of the last ``window`` records, if given) as the baseline (``pre``), or as ``post`` with the difference to it."""
    doc = table.store.read_json("meta/profiles/kpis.json") or {}
    now = kpis(table, window)
    if baseline:
        doc = {"pre_kpis": now}
    else:
        pre = doc.get("pre_kpis") or {}
        doc |= {"post_kpis": now, "delta_vs_pre": difference(pre, now)}
    doc["kpis_updated_at"] = table.now()
    table.store.write_json("meta/profiles/kpis.json", doc)
    return doc


def mined(log: DataFrame, where: str = "where") -> DataFrame:
    """(column, eq, range): conditions on each column; IN counts its list's length, BETWEEN as a range."""
    text = F.col(where)

    def found(pattern: str, kind: str, n: Column | None = None) -> DataFrame:
        return log.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("column")).select("column", F.lit(kind).alias("kind"), F.lit(1).alias("n"))

    lists = log.select(F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(IN), F.lit(1)).alias("c"), F.regexp_extract_all(text, F.lit(IN), F.lit(2)).alias("v"))).alias("x"))
    # arrays_zip names its fields by position here
    lists = lists.select(F.col("x")["c"].alias("column"), F.lit("eq").alias("kind"), F.size(F.split(F.col("x")["v"], ",")).alias("n"))
    every = found(EQUAL, "eq").union(found(RANGE, "range")).union(found(BETWEEN, "range")).union(lists)
    return every.groupBy("column").agg(F.sum(F.when(F.col("kind") == "eq", F.col("n")).otherwise(0)).alias("eq"), F.sum(F.when(F.col("kind") == "range", F.col("n")).otherwise(0)).alias("range"))


def advise(table: Table) -> dict[str, Any]:
    """Index, partition and order recommendations from the usage log and the profile."""
    log = records(table)
    counts = mined(log).collect()  # a row a column
    bloom = [r.column for r in sorted(counts, key=lambda r: (-r.eq, r.column)) if r.eq >= 2][:5]
    minmax = [r.column for r in sorted(counts, key=lambda r: (-r.range, r.column)) if r.range >= 2][:5]
    columns = (table.store.read_json("meta/profiles/quality.json") or {}).get("columns", {})
    distinct = {c: columns[c]["distinct_est"] for c in bloom if c in columns}
    partitions = [c for c in bloom if 5 <= distinct.get(c, 0) <= 2000][:3]
    order = next((c for c in minmax if c in columns), None)
    busy = (log.agg(F.percentile("chunks_scanned", F.lit(0.95))).first()[0] or 0) > 0
    savings = {}
    if busy and partitions:
        savings["partitions"] = round(1 - 1 / min(10, max(1.5, distinct[partitions[0]] ** 0.5)), 4)
    if busy and order:
        savings["ordering"] = 0.3
    return {"recommend": {"bloom": bloom, "minmax": minmax, "partitions": partitions, "order": order}, "estimated_savings": savings, "evidence": {r.column: {"eq": r.eq, "range": r.range} for r in counts}}


