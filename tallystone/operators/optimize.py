"""Compaction, re-clustering and index rebuilds: new immutable files, the old generation stays for its snapshots."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import usage as U

if TYPE_CHECKING:
    from ..sources.table import Table


def layout(df: DataFrame, part: str | None, target_rows: int, order: list[str], min_chunks: int = 1, tie: list[str] | None = None) -> DataFrame:
    """Rows with ``__chunk``: within each partition value, runs of ceil(n / max(min_chunks, ceil(n / target))) rows in ``order``.

    The numbering is exact: rows are counted by bins of the first column's values, and each bin is ordered by
    itself, so a partition value is dealt over as many tasks as it has bins. Rows that share their first
    column's value are ordered by one task, which spills, and so are all of them without an order;
    ``optimize`` leaves the cutting of files to the writer.
    """
    if target_rows <= 0:
        raise ValueError("target_rows must be positive")
    names = [*order, *(tie or [])]
    by = [F.asc_nulls_last(c) for c in names] or [F.lit(0)]
    sized = df.withColumns({"__key": F.col(part) if part else F.lit(0), "__bin": _bins(df, names[0]) if names else F.lit(0)})
    bins = sized.groupBy(F.col("__key").alias("__k"), F.col("__bin").alias("__b")).agg(F.count("*").alias("__c"))
    whole = Window.partitionBy("__k")
    before = F.coalesce(F.sum("__c").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("__k", "__b", F.sum("__c").over(whole).alias("__n"), before.alias("__before"))  # 257 rows of a partition value at most
    parts = F.greatest(F.lit(min_chunks), F.ceil(F.col("__n") / target_rows))
    step = F.ceil(F.col("__n") / parts)
    placed = sized.join(bins, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__bin") == F.col("__b")))
    rank = F.row_number().over(Window.partitionBy("__key", "__bin").orderBy(*by)) + F.col("__before")
    return placed.withColumn("__chunk", F.floor((rank - 1) / step)).drop("__n", "__key", "__bin", "__k", "__b", "__before")


#: Ranks that a column of a Z-order is cut into, as bits.
RANK_BITS = 8
#: Rows of a task that writes ranges of an order, where files have fewer; and as many ranges as are always files of their own.
RANGE_ROWS, RANGES = 500_000, 64


def _old_position() -> dict[str, Column]:
    """A scanned row's place in the table: its file's number, by generation, task and the task's files in turn, and its own in the file.

    Numbers, as paths of some hundred bytes would be sampled, shuffled and sorted with each row.
    """
    name = F.col("_metadata.file_name")
    number = lambda text: F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))
    generation = number(F.regexp_extract(F.col("_metadata.file_path"), r"/data/gen-(\d+)/", 1))
    task, count = (number(F.regexp_extract(name, x, 1)) for x in (r"^part-(\d+)", r"[-.]c(\d+)\."))
    return {"__file": F.shiftleft(generation, 40) + F.shiftleft(task, 20) + count, "__row": F.col("_metadata.row_index")}


def _position(column: Column, kind: T.DataType) -> Column:
    """A number that never falls where the column rises: of texts their first six bytes."""
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(column), 1, 12), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    raise ValueError(f"no order of {kind.simpleString()}")


def _rank(x: Column, cuts: list[float]) -> Column:
    """How many cuts are not above x, by halving; 0 for null."""

    def below(i: int, j: int) -> Column:
        if i == j:
            return F.lit(i)
        m = (i + j) // 2
        return F.when(x < cuts[m], below(i, m)).otherwise(below(m + 1, j))

    return F.when(x.isNull(), F.lit(0)).otherwise(below(0, len(cuts)))


def _bins(df: DataFrame, column: str) -> Column:
    """Bins of about as many rows each, that never fall where the column rises; nulls are in the last."""
    position, n = _position(F.col(column), df.schema[column].dataType), 1 << RANK_BITS
    cuts = sorted(set(df.select(position.alias("p")).approxQuantile("p", [i / n for i in range(1, n)], 0.2 / n)))
    return F.when(position.isNull(), F.lit(len(cuts) + 1)).otherwise(_rank(position, cuts))


def interleaved(df: DataFrame, columns: list[str]) -> Column:
    """The bits of the columns' ranks in turn, highest first: near values of all columns have near numbers."""
    if not 0 < len(columns) <= 62 // RANK_BITS:
        raise ValueError(f"a Z-order takes 1 to {62 // RANK_BITS} columns")
    places = {f"p{i}": _position(F.col(c), df.schema[c].dataType) for i, c in enumerate(columns)}
    n = 1 << RANK_BITS
    found = df.select(*[p.alias(k) for k, p in places.items()]).approxQuantile(list(places), [i / n for i in range(1, n)], 0.2 / n)
    z = F.lit(0).cast("long")
    for i, (position, cuts) in enumerate(zip(places.values(), found, strict=True)):
        rank = _rank(position, sorted(set(cuts))).cast("long")
        for bit in range(RANK_BITS):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), bit * len(columns) + len(columns) - 1 - i))
    return z


def optimize(table: Table, compact: bool = True, target_rows: int = 100_000, order: list[str] | None = None, min_chunks: int = 1, whole: bool = False, zorder: list[str] | None = None) -> dict[str, Any]:
    """Rewrite small files, or with an order or ``whole`` all files, fewer and sorted. Row order within files is ``order``, then the old position.

    A file is small with fewer rows than half the target; those that share their partition value with another
    small one are put together, and all other files are carried over by reference, under their names.
    With ``zorder``, all files are rewritten as ranges of the interleaved ranks of these columns, so that a
    condition on any one of them leaves few files.

    With an order, files are ranges of (partition value, order), so their statistics don't overlap;
    without, ranges of the old position, or of an unordered partitioned table what Spark's rebalancing
    makes. Up to 64 files are a task each; of more, small ones are written several by a task in the order's turn, so that
    tasks and what is sampled of their rows grow with the rows, not with the files. Encrypted tables are refused; nothing to do is an error.
    """
    if not compact and not order and not zorder:
        raise ValueError("Nothing to do: neither compact nor order")
    if order and zorder:
        raise ValueError("either order or zorder")
    if target_rows <= 0:
        raise ValueError("target_rows must be positive")
    if table.crypto():
        raise ValueError("an encrypted table can't be optimized")
    with table.store.lock():  # rows that are appended meanwhile aren't lost
        manifest = table.manifest()
        before, rows = table.stats(manifest).agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if not before:
            return {"changed": False, "reason": "no_chunks"}
        names = [f["name"] for f in manifest["schema"]]
        for c in [*(order or []), *(zorder or [])]:
            if c not in names:
                raise ValueError(f"unknown order column: {c}")
        part = manifest["partitions"][0]["by"] if manifest["partitions"] else None
        carried, chosen = None, None
        if not order and not zorder and not whole and min_chunks == 1:
            small = (F.col("rows") * 2 < target_rows).alias("small")
            beside = F.count("*").over(Window.partitionBy(*([f"min_{part}"] if part else [F.lit(0)]), small))  # files are few next to rows
            judged = table.stats(manifest).withColumn("again", small & (beside > 1))
            picked = judged.where("again").select("file", "rows").orderBy("file").collect()
            if not picked:
                return {"changed": False, "reason": "no_small_chunks"}
            chosen, rows = [r.file for r in picked], sum(r.rows for r in picked)
            carried = judged.where("not again").drop("again")
        df = table._scan(manifest, chosen).withColumns(_old_position())  # keeps equal rows in place
        ranges = None
        if order or zorder or not part:
            files = -(-rows // target_rows)
            ranges = max(min_chunks, min(files, max(RANGES, -(-rows // RANGE_ROWS))))
        if zorder:
            df = df.withColumn("__z", interleaved(df, zorder))
        pre = U.kpis(table)
        table._put(df, part, "optimize", old=manifest, order=order or (["ts"] if "ts" in names and not zorder else []), max_rows=target_rows, tie=("__z", "__file", "__row") if zorder else ("__file", "__row"), ranges=ranges, carried=carried, details={"order": order, "target_rows": target_rows, "before": before})
    table.snapshot(note="auto after optimize")
    fresh = table.manifest()
    after = fresh["chunks"]
    return {"changed": True, "new_parts": after, "reindexed_columns": sorted(fresh["indexes"]), "pre_kpis": pre, "order": order, "target_rows": target_rows}


def reindex(table: Table, spec: dict[str, dict[str, Any]]) -> list[str]:
    """Declare and build indexes: ``{column: {"minmax": {}, "bloom": {"fp_rate": 0.01}, "trigrams": {}}}``. Unknown columns are skipped."""
    with table.store.lock():
        manifest = table.manifest()
        names = [f["name"] for f in manifest["schema"]]
        locked = (table.crypto() or {}).get("columns", [])
        done = [c for c in spec if c in names and c not in locked]
        version = table.next_version()
        indexes = {c: set(k) for c, k in manifest["indexes"].items()}
        for c in done:
            indexes.setdefault(c, set()).update(spec[c])
        manifest = {**manifest, "generation": version, "indexes": {c: sorted(k) for c, k in indexes.items()}, "bloom": f"meta/index/bloom-{version:06d}", "more_blooms": []}
        blooms = {c: spec.get(c, {}).get("bloom") or {} for c, k in manifest["indexes"].items() if "bloom" in k}
        if blooms:
            table._build_blooms(table._scan(manifest), blooms, manifest["bloom"])
        else:
            manifest["bloom"] = None
        further = {c: {k: spec.get(c, {}).get(k) or {} for k in kinds} for c, kinds in manifest["indexes"].items() if c in names and c not in locked}
        manifest["kinds"] = {k: [p] for k, p in table._build_kinds(table._scan(manifest), further, version).items()}
        table._publish(version, manifest)
        table.journal_append("reindex", {"columns": done})
    return done
