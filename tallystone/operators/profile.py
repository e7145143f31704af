"""Column profiles and constraint checks, each one aggregate over the table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..sources.table import Table

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "number" if isinstance(kind, T.NumericType) else "string"


def _null(c: str, kind: T.DataType) -> Column:
    missing = F.col(c).isNull()
    return missing | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else missing


#: Ranges of values into which the search for an order statistic is cut.
RANGES = 128
#: So many different values, about, are ordered without ranges.
FEW = 50_000


def order_statistics(df: DataFrame, by: list[str], column: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``by``, n and, for each name of ``picks``, the value at that place (from 0) of the sorted non-null values; a pick is a function of n.

    Values are counted, the counts summed over ranges of values, and only the range that holds a place
    is ordered. So no group's values come together in one row or task, and a frequent value is one row.
    Groups without values are left out. Where there are at most FEW different values, one task orders their counts at once.
    """
    have = df.where(F.col(column).isNotNull()).select(F.struct(*by).alias("by") if by else F.lit(0).alias("by"), F.col(column).alias("value"))
    if (have.agg(F.approx_count_distinct(F.struct("by", "value"))).first()[0] or 0) <= FEW:
        each = have.groupBy("by", "value").agg(F.count("*").alias("n"))
        group = Window.partitionBy("by")
        each = each.withColumns({"up_to": F.sum("n").over(group.orderBy("value")), "total": F.sum("n").over(group)})
        here = {name: (pick(F.col("total")).cast("long") >= F.col("up_to") - F.col("n")) & (pick(F.col("total")).cast("long") < F.col("up_to")) for name, pick in picks.items()}
        out = each.groupBy("by").agg(F.max("total").alias("n"), *[F.max(F.when(test, F.col("value"))).alias(name) for name, test in here.items()])
        return out.select(*[F.col("by")[c].alias(c) for c in by], "n", *picks)
    cuts = sorted(set(have.select(F.col("value").cast("double")).approxQuantile("value", [i / RANGES for i in range(1, RANGES)], 0.2 / RANGES)))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("value").cast("double"))) if cuts else F.lit(0)
    counts = have.groupBy("by", place.alias("range"), "value").agg(F.count("*").alias("n"))
    ranges = counts.groupBy("by", "range").agg(F.sum("n").alias("held"))  # at most RANGES rows a group
    of_group = Window.partitionBy("by")
    ranges = ranges.withColumns({"total": F.sum("held").over(of_group), "before": F.sum("held").over(of_group.orderBy("range")) - F.col("held")})
    asked = ranges.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), pick(F.col("total")).cast("long").alias("at")) for name, pick in picks.items()])).alias("pick"))
    asked = asked.select("by", "range", "total", F.col("pick.name").alias("name"), (F.col("pick.at") - F.col("before")).alias("within"), "held").where("within >= 0 AND within < held")
    up_to = F.sum("n").over(Window.partitionBy("by", "range", "name").orderBy("value"))
    found = counts.join(asked, ["by", "range"]).withColumn("up_to", up_to).where("within < up_to AND within >= up_to - n")
    out = found.groupBy("by").agg(F.max("total").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in picks])
    return out.select(*[F.col("by")[c].alias(c) for c in by], "n", *picks)


def quantiles(df: DataFrame, by: list[str], column: str, wanted: dict[str, float], interpolate: bool = False) -> DataFrame:
    """``by`` and exact quantiles: sorted[ceil(q * (n - 1))], or interpolated between neighbours."""
    if not interpolate:
        return order_statistics(df, by, column, {k: lambda n, q=q: F.ceil(F.lit(q) * (n - 1)) for k, q in wanted.items()}).drop("n")
    ends = {f"{k}{end}": (lambda n, q=q, f=f: f(F.lit(q) * (n - 1))) for k, q in wanted.items() for end, f in (("_low", F.floor), ("_high", F.ceil))}
    got = order_statistics(df, by, column, ends)

    def between(k: str, q: float) -> Column:
        at = F.lit(q) * (F.col("n") - 1)
        return F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * (at - F.floor(at))

    return got.select(*by, *[between(k, q).alias(k) for k, q in wanted.items()])


def _read_as(df: DataFrame, kinds: dict[str, str] | None) -> DataFrame:
    """``df`` with text columns read as ``number`` or ``datetime``."""
    for c, kind in (kinds or {}).items():
        df = df.withColumn(c, F.col(c).try_cast({"number": "double", "datetime": "timestamp"}[kind]))
    return df


def _partials(schema: T.StructType, names: list[str], exact: bool = False) -> list[Column]:
    """Aggregates that a profile is made of: rows, and for the i-th column n (nulls), lo, hi, d (HLL sketch) and k (KLL sketch of numbers)."""
    made = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        kind = schema[c].dataType
        plain = F.when(~_null(c, kind), F.col(c))
        ordered = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        made += [F.sum(_null(c, kind).cast("long")).alias(f"n{i}"), (F.min(plain) if ordered else F.max(F.lit(None).cast("string"))).alias(f"lo{i}"), (F.max(plain) if ordered else F.max(F.lit(None).cast("string"))).alias(f"hi{i}")]
        text = F.to_json(F.struct(plain.alias("v"))) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else plain.cast("string")
        made.append((F.countDistinct(text) if exact else F.hll_sketch_agg(text, 14)).alias(f"d{i}"))
        if kind_of(kind) == "number":
            made.append(F.call_function("kll_sketch_agg_double", plain.cast("double")).alias(f"k{i}"))
    return made


def _merging(schema: T.StructType, names: list[str]) -> list[Column]:
    """Aggregates that make one row of partials of several."""
    made = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")]
    for i, c in enumerate(names):
        made += [F.sum(f"n{i}").alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"), F.hll_union_agg(f"d{i}").alias(f"d{i}")]
        if kind_of(schema[c].dataType) == "number":
            made.append(F.call_function("kll_merge_agg_double", f"k{i}").alias(f"k{i}"))
    return made


def _report(one: DataFrame, schema: T.StructType, names: list[str], exact: bool = False) -> DataFrame:
    """The profile's rows from one row of partials."""
    rows = []
    for i, c in enumerate(names):
        numeric = kind_of(schema[c].dataType) == "number"
        # null where all values are null, since an empty sketch has no quantile
        empty = F.coalesce(F.col(f"n{i}"), F.lit(0)) >= F.col("rows")
        quantiles = [(F.when(~empty, F.call_function("kll_sketch_get_quantile_double", F.col(f"k{i}"), F.lit(q))) if numeric else F.lit(None).cast("double")).alias(p) for p, q in QUANTILES.items()]
        distinct = F.col(f"d{i}") if exact else F.hll_sketch_estimate(f"d{i}")
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind_of(schema[c].dataType)).alias("dtype"), F.col("rows"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("nulls"),
                F.when(F.col("rows") > 0, F.col(f"n{i}") / F.col("rows")).otherwise(0.0).alias("null_pct"), F.col(f"lo{i}").cast("string").alias("min"), F.col(f"hi{i}").cast("string").alias("max"), F.coalesce(distinct, F.lit(0)).alias("distinct_est"), *quantiles,
            )
        )
    return one.select(F.inline(F.array(*rows)))


def profile_frame(df: DataFrame, columns: list[str] | None = None, exact: bool = False, kinds: dict[str, str] | None = None) -> DataFrame:
    """One row a column: dtype, rows, nulls, null_pct, min, max, distinct_est, p50, p95, p99 (numbers only).

    One pass: HyperLogLog and KLL sketches merge partial results on the map side. With ``exact``
    distinct values are counted instead, which shuffles each column's values. ``kinds`` has text columns
    read as ``number`` or ``datetime``; text that isn't one counts as null.
    """
    df = _read_as(df, kinds)
    names = columns or df.columns
    return _report(df.agg(*_partials(df.schema, names, exact)), df.schema, names, exact)


def sketched(table: Table, manifest: dict[str, Any]) -> DataFrame:
    """Partial profiles of the manifest's files, one row a file: those that are stored, after those that aren't have been made.

    Each commit's sketches are a folder beside its statistics, made when a profile first asks for them,
    so a profile after an append reads the new files only. They go with the files: ``vacuum`` knows their
    generation. A file with few values has small sketches; at most 16 KB of HLL and some KB of KLL a column.
    """
    schema = T.StructType.fromJson(manifest["spark_schema"])
    files = table.stats(manifest).select("file", F.regexp_extract("file", r"/data/(gen-\d+)/", 1).alias("generation"))
    there = set(table.store.names("meta/index"))
    of_now = [r.generation for r in files.select("generation").distinct().orderBy("generation").collect()]  # a row a commit
    folders = {g: f"sketch-{g.removeprefix('gen-')}" for g in of_now}
    for g in [g for g in of_now if folders[g] not in there or not table.store.exists(f"meta/index/{folders[g]}/_SUCCESS")]:
        data = table._folder(f"{table.path}/data/{g}", schema)
        data = data.groupBy(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file")).agg(*_partials(schema, schema.names))
        data.write.mode("overwrite").parquet(f"{table.path}/meta/index/{folders[g]}")
    stored = table.spark.read.parquet(*[f"{table.path}/meta/index/{f}" for f in folders.values()])
    return stored.join(files.select("file"), "file", "left_semi")


def profile_table(table: Table) -> DataFrame:
    """The profile of a table's current rows, merged from its files' sketches."""
    manifest = table.manifest()
    schema = T.StructType.fromJson(manifest["spark_schema"])
    return _report(sketched(table, manifest).agg(*_merging(schema, schema.names)), schema, schema.names)


def violations(df: DataFrame, constraints: dict[str, dict[str, Any]]) -> DataFrame:
    """(column, rule, bad, sample): every broken rule with the rows that break it and up to ten values.

    Rules: not_null, enum [..], min, max, valid_range [low, high]; bounds are inclusive. All counts come from one aggregate.
    """
    checks: list[tuple[str, str, Column]] = []
    for c, rules in constraints.items():
        if c not in df.columns:
            raise ValueError(f"constraint on unknown column: {c}")
        kind, v = df.schema[c].dataType, F.col(c)
        absent = _null(c, kind)

        def number(x, k=kind):
            return F.lit(float(x)) if kind_of(k) == "number" else F.lit(x).cast(k)

        for rule, want in rules.items():
            if rule == "not_null" and want:
                checks.append((c, rule, absent))
            elif rule == "enum":
                checks.append((c, rule, ~absent & ~v.cast("string").isin([str(x) for x in want])))
            elif rule in ("min", "max"):
                checks.append((c, rule, ~absent & (v < number(want) if rule == "min" else v > number(want))))
            elif rule == "valid_range":
                checks.append((c, rule, ~absent & ~v.between(number(want[0]), number(want[1]))))
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, rule string, bad long, sample array<string>")
    one = df.agg(*[F.sum(b.cast("long")).alias(f"b{i}") for i, (_, _, b) in enumerate(checks)])
    counted = one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(r).alias("rule"), F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("bad")) for i, (c, r, _) in enumerate(checks)]))).where("bad > 0")
    hit = df.select(F.explode(F.filter(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("value"))) for i, (c, _, b) in enumerate(checks)]), lambda x: x.isNotNull())).alias("x")).select("x.*").where("value is not null").distinct()
    ten = hit.withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy("value"))).where("rn <= 10").groupBy("i").agg(F.array_sort(F.collect_list("value")).alias("sample"))
    return counted.join(ten, "i", "left").select("column", "rule", "bad", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def validate(table: Table) -> dict[str, Any]:
    """Profile the table, store the profile, then check its constraints: broken ones raise one ValueError.

    After an append only the new files are read: the profile is merged from the files' sketches, and
    files that have passed the same constraints before aren't checked again.
    """
    manifest = table.manifest()
    files = table.stats(manifest).select("file")
    if not files.take(1):
        raise ValueError("no chunks to validate")
    rows = profile_table(table).collect()  # a row a column
    keys = ("dtype", "nulls", "null_pct", "min", "max", "distinct_est", "p50", "p95", "p99")
    doc = {"version": 1, "rows": rows[0].rows if rows else 0, "columns": {r.column: {k: r[k] for k in keys} for r in rows}}
    table.store.write_json("meta/profiles/quality.json", doc)
    rules = {f["name"]: f["constraints"] for f in manifest["schema"] if f.get("constraints")}
    if rules:
        passed = f"meta/profiles/passed-{hashlib.sha256(json.dumps([rules, manifest['spark_schema']], sort_keys=True, default=str).encode()).hexdigest()[:16]}"
        before = table.spark.read.schema("file string").parquet(f"{table.path}/{passed}") if table.store.exists(passed) else files.limit(0)
        fresh = [r.file for r in files.join(before, "file", "left_anti").orderBy("file").collect()]
        bad = violations(table._scan(manifest, fresh), rules).orderBy("column", "rule").collect() if fresh else []
        if bad:
            raise ValueError("VALIDATION FAILED:\n" + "\n".join(f"- {r.column}: {r.rule} broken by {r.bad} rows" + (f" ({', '.join(r.sample)})" if r.sample else "") for r in bad))
        if fresh:
            table.spark.createDataFrame([(f,) for f in fresh], "file string").coalesce(1).write.mode("append").parquet(f"{table.path}/{passed}")
    table.journal_append("validate", {"rows": doc["rows"]})
    return doc
