"""A versioned table in a folder: immutable Parquet files, a manifest, statistics, snapshots, a journal.

    data/gen-000001/part=<value>/part-*.parquet    never rewritten
    meta/CURRENT.json                             the manifest's number: the one thing that moves
    meta/manifest-000001.json                     schema, constraints, partitioning, indexes, files' statistics
    meta/index/stats-000001/                      one row per file of a commit: rows, bytes, min, max, nulls
    meta/index/bloom-000001/                      one row per file and column of a commit
    meta/index/kind-trigrams-000001/              the same of a further kind of index
    meta/{snapshots,journal,audit,usage,profiles}

Files hold all columns, so reading needs no partition discovery; partition values are
pruned by statistics like any other column, and null ones are kept.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry
from ..operators import stats as S
from ..plans import predicate as P
from .store import Store

ARROW = [(T.TimestampType, "timestamp[us, UTC]"), (T.TimestampNTZType, "timestamp[us, UTC]"), (T.DateType, "timestamp[us, UTC]"), (T.IntegralType, "int64"), (T.FractionalType, "float64")]


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def arrow_type(kind: T.DataType) -> str:
    """The manifest's four type names."""
    return next((name for cls, name in ARROW if isinstance(kind, cls)), "utf8")


def load_source(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A DataFrame, or a ``.csv`` or ``.parquet`` path; other suffixes raise ValueError."""
    if isinstance(source, DataFrame):
        return source
    if source.lower().endswith(".csv"):
        return spark.read.csv(source, header=True, inferSchema=True)
    if source.lower().endswith(".parquet"):
        return spark.read.parquet(source)
    raise ValueError(f"Unsupported source: {source}")


def _part(manifest: dict[str, Any]) -> str | None:
    return manifest["partitions"][0]["by"] if manifest["partitions"] else None


#: Types in the order in which each holds all values of those before it.
_WIDER = [[T.ByteType, T.ShortType, T.IntegerType, T.LongType], [T.ByteType, T.ShortType, T.IntegerType, T.DoubleType], [T.ByteType, T.ShortType, T.FloatType, T.DoubleType], [T.DateType, T.TimestampNTZType], [T.DateType, T.TimestampType]]


def _holds(wide: T.DataType, narrow: T.DataType) -> bool:
    """Whether every value of one type is one of the other."""
    if wide == narrow or isinstance(narrow, T.NullType):
        return True
    if isinstance(wide, T.DecimalType) and isinstance(narrow, T.DecimalType):
        return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
    if isinstance(wide, T.ArrayType) and isinstance(narrow, T.ArrayType):
        return _holds(wide.elementType, narrow.elementType)
    if isinstance(wide, T.StructType) and isinstance(narrow, T.StructType):
        return wide.names == narrow.names and all(_holds(a.dataType, b.dataType) for a, b in zip(wide, narrow, strict=True))
    return any(type(wide) in chain and type(narrow) in chain[: chain.index(type(wide))] for chain in _WIDER)


def fitted(df: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """``df`` with the columns ``kinds`` in their types; ValueError where one is missing or might lose values. Other columns are not taken."""
    missing = [c for c in kinds if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    wrong = [f"{c} is {df.schema[c].dataType.simpleString()}, not {k.simpleString()}" for c, k in kinds.items() if not _holds(k, df.schema[c].dataType)]
    if wrong:
        raise ValueError(f"columns of other types: {'; '.join(wrong)}")
    return df.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


#: Commits after which their statistics are written together.
MANY_COMMITS = 64


class Table:
    """Reads and writes of one table. ``clock`` gives the time of commits."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], dt.datetime] = utc_now):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        self.store = Store(spark, path)

    # ------------------------------------------------------------ documents

    def now(self) -> str:
        return self.clock().astimezone(dt.UTC).isoformat().replace("+00:00", "Z")

    def version(self) -> int:
        return (self.store.read_json("meta/CURRENT.json") or {}).get("version", 0)

    def next_version(self) -> int:
        """The number of the next commit; under the lock."""
        return 1 + max([self.version(), *(int(n[9:15]) for n in self.store.names("meta") if n.startswith("manifest-"))])

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        v = version or self.version()
        if not v:
            raise FileNotFoundError(f"no table at {self.path}")
        return self.store.read_json(f"meta/manifest-{v:06d}.json")

    def manifest_hash(self, manifest: dict[str, Any]) -> str:
        return "sha256:" + hashlib.sha256(json.dumps(manifest, ensure_ascii=False).encode()).hexdigest()

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(self.manifest(version)["spark_schema"])

    def crypto(self, manifest: dict[str, Any] | None = None) -> dict[str, Any] | None:
        """How columns are encrypted, in the current manifest or another; each manifest has its own, so it fits its files."""
        manifest = manifest or (self.manifest() if self.version() else {})
        return manifest["crypto"] if "crypto" in manifest else self.store.read_json("meta/crypto.json")

    def stats(self, manifest: dict[str, Any]) -> DataFrame:
        """One row per file with its statistics."""
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in _stats_paths(manifest)])

    def blooms(self, manifest: dict[str, Any]) -> DataFrame | None:
        """One row per file and column with its Bloom filter, if there is any."""
        paths = [p for p in [manifest.get("bloom"), *manifest.get("more_blooms", [])] if p]
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in paths]) if paths else None

    def kind_rows(self, manifest: dict[str, Any], kind: str) -> DataFrame | None:
        """One row per file and column of a further kind of index, if there is any."""
        paths = manifest.get("kinds", {}).get(kind)
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in paths]) if paths else None

    # ------------------------------------------------------------ journal

    def journal_append(self, op: str, details: dict[str, Any]) -> None:
        with self.store.lock("meta/.journal.lock"):
            ids = [int(n.split(".")[0]) for n in self.store.names("meta/journal")]
            n = max(ids, default=0) + 1
            self.store.write_text(f"meta/journal/{n:08d}.json", json.dumps({"id": n, "ts": self.now(), "op": op, "details": json.dumps(details, ensure_ascii=False, default=str)}, ensure_ascii=False))

    def log(self) -> DataFrame:
        """Journal events (id, ts, op, details as JSON) by id."""
        schema = "id long, ts string, op string, details string"
        if not self.store.names("meta/journal"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/meta/journal").orderBy("id")

    # ------------------------------------------------------------ write

    def write(
        self,
        source: DataFrame | str,
        partition_by: list[str] | None = None,
        constraints: dict[str, dict[str, Any]] | None = None,
        indexes: dict[str, dict[str, Any]] | None = None,
        auto_snapshot: bool = True,
        order: list[str] | None = None,
    ) -> Table:
        """Replace the table's content. Partitioned by the first of ``partition_by`` (``country`` if there is such a column), sorted by ``ts`` within files."""
        df = load_source(self.spark, source)
        if partition_by:
            if partition_by[0] not in df.columns:
                raise ValueError(f"partition column not found: {partition_by[0]}")
            part = partition_by[0]
        else:
            part = "country" if "country" in df.columns else None
        if "ts" in df.columns and isinstance(df.schema["ts"].dataType, T.StringType):
            df = df.withColumn("ts", F.try_to_timestamp("ts"))
        return self._commit(df, part, "write", constraints=constraints, indexes=indexes, snapshot=auto_snapshot, order=order or (["ts"] if "ts" in df.columns else []))

    def append(self, source: DataFrame | str, passphrase: str | None = None, stream: tuple[str, int] | None = None) -> Table:
        """Add rows in new files; earlier files and snapshots stay as they are, and only the new files are indexed.

        Columns are taken by name and widened to the table's types; a missing column, or one that a type
        may lose values of, is refused. An encrypted table needs its passphrase, and the new values are
        encrypted too. ``stream`` (name, batch) is recorded in the same commit; a batch that is there already is skipped.
        """
        from ..operators import encrypt

        df = load_source(self.spark, source)
        with self.store.lock():
            m, schema = self.manifest(), self.schema()
            if stream and m.get("streams", {}).get(stream[0], -1) >= stream[1]:
                return self
            config = self.crypto(m)
            kinds = {f.name: (T._parse_datatype_json_value(config["kinds"][f.name]) if config and f.name in config["columns"] else f.dataType) for f in schema}
            df = fitted(df, kinds)
            if config:
                if passphrase is None:
                    raise ValueError("appending to an encrypted table needs its passphrase")
                df = encrypt.closed(df, self, config, config["columns"], passphrase, self.next_version(), _part(m))
            self._put(df, _part(m), "append", old=m, order=["ts"] if "ts" in df.columns and "ts" not in (config or {}).get("columns", []) else [], crypto=config, stream=stream)
        self.snapshot(note="auto after append")
        return self

    def _write_files(self, df: DataFrame, part: str | None, generation: int, order: list[str], max_rows: int | None = None, tie: tuple[str, ...] = (), ranges: int | None = None) -> str:
        folder = f"{self.path}/data/gen-{generation:06d}"
        by = [F.asc_nulls_last(c) for c in order]
        if part:
            # rebalancing keeps a value's rows together and splits values that are too large for one file
            df = (df if ranges else df.hint("rebalance", part)).withColumn("__part", F.col(part))
        lead = ["__part"] if part else []
        if ranges:  # files hold ranges of the order, so that their statistics don't overlap
            df = df.repartitionByRange(ranges, *lead, *by, *tie)
        if part or order:
            df = df.sortWithinPartitions(*lead, *by, *tie)
        writer = df.drop(*tie).write.option("compression", "zstd")
        if max_rows:
            writer = writer.option("maxRecordsPerFile", max_rows)
        (writer.partitionBy("__part") if part else writer).parquet(folder)
        return folder

    def _folder(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    def _stats_of(self, folder: str, schema: T.StructType) -> DataFrame:
        sizes = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select(F.col("path").alias("p"), F.col("length").alias("bytes"))
        plain = F.regexp_replace("file", "^file:/+", "file:/")
        stats = S.file_stats(self._folder(folder, schema), S.ordered_columns(schema)).withColumn("file", plain)
        return stats.join(sizes.select(F.regexp_replace("p", "^file:/+", "file:/").alias("file"), "bytes"), "file", "left")

    def _commit(self, df: DataFrame, part: str | None, op: str, *, snapshot: bool = True, **how) -> Table:
        with self.store.lock():
            self._put(df, part, op, **how)
        if snapshot:
            self.snapshot(note=f"auto after {op}")
        return self

    def _put(
        self, df: DataFrame, part: str | None, op: str, *, old: dict | None = None, constraints=None, indexes=None, order=(), max_rows: int | None = None, details: dict | None = None, tie: tuple[str, ...] = (),
        ranges: int | None = None, crypto: dict | None = None, stream: tuple[str, int] | None = None, publish: bool = True, carried: DataFrame | None = None,
        onto: dict | None = None,
    ) -> int:
        """Write, index and publish one version; call it under the lock. An append reads and writes nothing of earlier files.

        ``carried`` are statistics of files of ``old`` that stay as they are; ``onto`` is a manifest whose files all come first, as in an append.

        Without ``publish`` its manifest is written, but the table stays at its version.
        """
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema if f.name not in tie])
        for kind in {k for v in (indexes or {}).values() for k in v} - {"minmax", "bloom"}:
            registry.get(kind)
        version = self.next_version()
        folder = self._write_files(df, part, version, list(order), max_rows, tie, ranges)
        keep = onto or (old if op == "append" else None)
        chunks, rows = (keep["chunks"], keep["rows"]) if keep else (0, 0)
        path = f"meta/index/stats-{version:06d}"
        stats = self._stats_of(folder, schema)
        self._number(stats if carried is None else stats.unionByName(carried.select(*stats.columns)), chunks, path)
        declared = indexes if indexes is not None else (old or {}).get("indexes", {})
        declared = {c: ({k: {} for k in v} if isinstance(v, list) else dict(v)) for c, v in declared.items()}
        if part:
            declared.setdefault(part, {}).setdefault("bloom", {})
        if "ts" in schema.names:
            declared.setdefault("ts", {}).setdefault("minmax", {})
        built = self._build_kinds(self._folder(folder, schema), {c: v for c, v in declared.items() if c in schema.names and c not in (crypto or {}).get("columns", [])}, version)
        for kind, path_of in built.items():
            if carried is not None and (had := self.kind_rows(old, kind)) is not None:
                had.join(carried.select("file"), "file", "left_semi").write.mode("append").parquet(f"{self.path}/{path_of}")
        blooms = {c: v["bloom"] for c, v in declared.items() if "bloom" in v and c in schema.names and c not in (crypto or {}).get("columns", [])}
        filters = f"meta/index/bloom-{version:06d}" if blooms else None
        if blooms:
            self._build_blooms(self._folder(folder, schema), blooms, filters)
            if carried is not None and (had := self.blooms(old)) is not None:
                had.join(carried.select("file"), "file", "left_semi").write.mode("append").parquet(f"{self.path}/{filters}")
        n, more = self.spark.read.parquet(f"{self.path}/{path}").agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        rules = constraints if constraints is not None else {x["name"]: x.get("constraints") for x in (old or {}).get("schema", [])}
        manifest = {
            "version": 1, "name": self.path.rsplit("/", 1)[-1],
            "schema": [{"name": f.name, "arrow_type": arrow_type(f.dataType)} | ({"constraints": c} if (c := rules.get(f.name)) else {}) for f in schema],
            "primary_key": None, "partitions": [{"by": part}] if part else [], "indexes": {c: sorted(v) for c, v in declared.items()},
            "created_at": (old or {}).get("created_at") or self.now(), "spark_schema": schema.jsonValue(), "generation": version, "chunks": chunks + n, "rows": rows + more,
            "stats": keep["stats"] if keep else path, "more_stats": [*keep.get("more_stats", []), path] if keep else [],
            "bloom": keep["bloom"] if keep and keep["bloom"] else filters, "more_blooms": [*keep.get("more_blooms", []), *([filters] if filters and keep["bloom"] else [])] if keep else [],
            "kinds": {k: [*(keep or {}).get("kinds", {}).get(k, []), *([built[k]] if k in built else [])] for k in {**(keep or {}).get("kinds", {}), **built}},
            "crypto": crypto, "streams": {**(old or {}).get("streams", {}), **({stream[0]: stream[1]} if stream else {})},
        }
        if len(manifest["more_stats"]) >= MANY_COMMITS:  # so that readers open few folders, at a cost that each commit shares
            manifest = self._merged(manifest, version)
        self.store.write_json(f"meta/manifest-{version:06d}.json", manifest)
        if publish:
            self.store.write_json("meta/CURRENT.json", {"version": version})
            self.store.write_json("meta/profiles/rows.json", {"version": 1, "rows": manifest["rows"]})
            self.journal_append(op, details or {"rows": manifest["rows"], "chunks": manifest["chunks"]})
        return version

    def _number(self, stats: DataFrame, first: int, path: str) -> None:
        # files are few next to rows: their numbering may pass through one task
        stats.withColumn("chunk_id", F.row_number().over(Window.orderBy("file")) - 1 + first).coalesce(1).write.parquet(f"{self.path}/{path}")

    def _merged(self, manifest: dict, version: int) -> dict:
        """The same manifest with the statistics and filters of all commits in one folder each."""
        out = {**manifest, "stats": f"meta/index/stats-{version:06d}-all", "more_stats": [], "more_blooms": []}
        self.stats(manifest).coalesce(1).write.parquet(f"{self.path}/{out['stats']}")
        if manifest["bloom"]:
            out["bloom"] = f"meta/index/bloom-{version:06d}-all"
            self.blooms(manifest).write.parquet(f"{self.path}/{out['bloom']}")
        for kind, paths in manifest["kinds"].items():
            out["kinds"] = {**out["kinds"], kind: [f"meta/index/kind-{kind}-{version:06d}-all"]}
            self.spark.read.parquet(*[f"{self.path}/{p}" for p in paths]).write.parquet(f"{self.path}/{out['kinds'][kind][0]}")
        return out

    def _build_blooms(self, data: DataFrame, blooms: dict[str, dict], path: str) -> None:
        for c, options in blooms.items():
            S.file_blooms(data, c, float(options.get("fp_rate", 0.01))).withColumn("column", F.lit(c)).withColumn("file", F.regexp_replace("file", "^file:/+", "file:/")).write.mode("append").parquet(f"{self.path}/{path}")

    def _build_kinds(self, data: DataFrame, declared: dict[str, dict[str, dict]], version: int) -> dict[str, str]:
        """Build the declared indexes of registered kinds beside min/max and Bloom filters; the folder of each kind."""
        folders = {}
        for c, kinds in declared.items():
            for kind, options in kinds.items():
                if kind not in ("minmax", "bloom"):
                    folders[kind] = f"meta/index/kind-{kind}-{version:06d}"
                    rows = registry.get(kind).build(data, c, **options)
                    rows.withColumn("column", F.lit(c)).withColumn("file", F.regexp_replace("file", "^file:/+", "file:/")).write.mode("append").parquet(f"{self.path}/{folders[kind]}")
        return folders

    def _publish(self, version: int, manifest: dict) -> None:
        self.store.write_json(f"meta/manifest-{version:06d}.json", manifest)
        self.store.write_json("meta/CURRENT.json", {"version": version})

    def vacuum(self) -> list[str]:
        """Delete generations, statistics and filters that neither the current manifest nor a snapshot names; call it under the lock."""
        kept = [self.manifest(n) for n in {self.version(), *(self.store.read_json(f"meta/{s['file']}")["manifest"] for s in self.list_snapshots())}]
        data = {r.g for m in kept for r in self.stats(m).select(F.regexp_extract("file", r"/data/(gen-\d+)/", 1).alias("g")).distinct().collect()}
        index = {g.replace("gen-", "sketch-") for g in data} | {p.rsplit("/", 1)[-1] for m in kept for p in _index_paths(m)}
        gone = [f"data/{n}" for n in self.store.names("data") if n not in data] + [f"meta/index/{n}" for n in self.store.names("meta/index") if n not in index]
        numbers = {m["generation"] for m in kept}
        gone += [f"meta/{n}" for n in self.store.names("meta") if n.startswith("manifest-") and int(n[9:15]) not in numbers]
        for name in gone:
            self.store.delete(name)
        return gone

    # ------------------------------------------------------------ read

    def _index(self, manifest: dict) -> DataFrame:
        """One row per file with its statistics and, as ``bloom_c``, its Bloom filters."""
        stats, b = self.stats(manifest), self.blooms(manifest)
        if b is None:
            return stats
        by = b.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("m", "k", "words")))).alias("blooms"))
        return stats.join(by, "file", "left")

    def _candidates(self, manifest: dict, tree: P.Tree | None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["spark_schema"])
        index = self._index(manifest)
        stats = [c.removeprefix("min_") for c in index.columns if c.startswith("min_")]
        bloomed = [c for c, kinds in manifest["indexes"].items() if "bloom" in kinds] if manifest.get("bloom") else []

        def bloom(column: str, value):
            if column not in bloomed:
                return F.lit(True)
            b = F.try_element_at("blooms", F.lit(column))
            return S.may_hold(value.cast(schema[column].dataType), b["m"], b["k"], b["words"])

        tree_down = P.pushed_down(tree) if tree is not None else None
        flags: dict[P.Test, list[str]] = {}
        for kind in manifest.get("kinds", {}):
            if not registry.known(kind):  # registered elsewhere: its files are read
                continue
            ask = registry.get(kind).may_match
            for c, tests in _by_column(P.tests_of(tree_down)).items():
                if kind not in manifest["indexes"].get(c, []):
                    continue
                made = {}
                for t in tests:
                    name = f"__{kind}_{len(flags)}_{len(made)}"
                    if (passed := _asked(ask, t, schema[c].dataType)) is not None:
                        made[name] = passed
                        flags.setdefault(t, []).append(name)
                if made:
                    rows = self.kind_rows(manifest, kind).where(F.col("column") == c)
                    index = index.join(rows.select("file", *[x.alias(n) for n, x in made.items()]), "file", "left")

        def other(t: P.Test):
            return reduce(lambda a, b: a & b, [F.coalesce(F.col(n), F.lit(True)) for n in flags.get(t, [])], F.lit(True))

        return index.where(P.may_match(tree, schema, stats, bloom, other)).drop(*[n for names in flags.values() for n in names])

    def _scan(self, manifest: dict, files: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["spark_schema"])
        if files is None:
            files = [r.file for r in self.stats(manifest).select("file").orderBy("file").collect()]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def added(self, manifest: dict, base: dict) -> list[str] | None:
        """The files that ``manifest`` has beside those of ``base``, where appends alone lie between them; else None."""
        paths, first = _stats_paths(manifest), _stats_paths(base)
        alike = all(manifest.get(k) == base.get(k) for k in ("spark_schema", "partitions", "indexes", "crypto"))
        if not alike or len(paths) == len(first) or paths[: len(first)] != first:
            return None
        more = self.spark.read.parquet(*[f"{self.path}/{p}" for p in paths[len(first) :]])
        return [r.file for r in more.select("file").orderBy("file").collect()]

    def manifest_as_of(self, as_of: str | None) -> dict[str, Any]:
        """The current manifest, or that of the newest snapshot not after ``as_of``; none raises ValueError."""
        if as_of is None:
            return self.manifest()
        return self.manifest(self.get_snapshot(as_of)["manifest"])

    def read(
        self,
        columns: list[str] | None = None,
        where: str | None = None,
        as_of: str | None = None,
        head: int | None = None,
        passphrase: str | None = None,
        usage: bool = False,
        audit: bool = False,
    ) -> DataFrame:
        """Rows that match ``where``: files pruned by statistics before the scan, the rest pushed down.

        All columns where ``columns`` is None. ``head`` keeps the first rows in file order.
        ``usage`` and ``audit`` record the read (both off by default). Encrypted columns that are
        asked for or tested need the passphrase.
        """
        from ..operators import encrypt

        manifest = self.manifest_as_of(as_of)
        schema = T.StructType.fromJson(manifest["spark_schema"])
        tree = P.parse(where)
        config = self.crypto(manifest) or {}
        locked = [c for c in config.get("columns", []) if c in schema.names]
        wanted = list(columns) if columns is not None else [c for c in schema.names if passphrase is not None or c not in locked]
        for c in wanted:
            if c not in schema.names:
                raise ValueError(f"unknown column: {c}")
        tested = P.columns_of(tree)
        need = [c for c in locked if c in wanted or c in tested]
        if need and passphrase is None:
            raise ValueError(f"encrypted columns need a passphrase: {', '.join(need)}")
        found = self._candidates(manifest, None if need and set(need) & set(tested) else tree).select("file", "bytes", "rows").orderBy("file").collect()
        if head is not None and tree is None:  # only the first files that hold so many rows
            have = 0
            found = [r for r in found if have < head and (have := have + r.rows) is not None]
        df = self._scan(manifest, [r.file for r in found])
        if head is not None:
            df = df.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}) if found else df.withColumns({"__file": F.lit(""), "__row": F.lit(0)})
        if need:
            df = encrypt.decrypted(df, self, need, passphrase, config)
            schema = T.StructType([df.schema[c] if c in df.columns else schema[c] for c in schema.names])
        if tree is not None:
            df = df.where(P.condition(tree, schema))
        if head is not None:
            df = df.orderBy("__file", "__row").limit(head)
        if usage:
            record = {"ts": self.now(), "where": where, "columns": wanted, "bytes_read": sum(r.bytes or 0 for r in found), "chunks_scanned": len(found), "as_of": as_of}
            with self.store.lock("meta/.usage.lock"):
                n = len(self.store.names("meta/usage")) + 1
                self.store.write_text(f"meta/usage/{n:08d}.json", json.dumps(record, ensure_ascii=False))
        if audit:
            from ..operators import audit as A

            A.append(self, {"op": "read", "where": where, "columns": wanted})
        return df.select(*wanted)

    # ------------------------------------------------------------ explain

    def plan(self, where: str | None = None, as_of: str | None = None) -> dict[str, Any]:
        """Which files a read would scan, by column and in all, with the index's summary."""
        manifest = self.manifest_as_of(as_of)
        tree = P.parse(where)
        index = self._index(manifest)
        total = index.count()
        final = self._candidates(manifest, tree).select("chunk_id", "file").orderBy("chunk_id").collect()
        by_column = {c: [r.chunk_id for r in self._candidates(manifest, one).select("chunk_id").orderBy("chunk_id").collect()] for c in P.columns_of(tree) if (one := _only(tree, c)) is not None}
        minmax = {}
        if "min_ts" in index.columns:
            low, high = index.agg(F.min("min_ts"), F.max("max_ts")).first()
            minmax = {"global_min": low, "global_max": high}
        bloom = {"n_chunks_indexed": 0}
        if (filters := self.blooms(manifest)) is not None:
            b = filters.agg(F.countDistinct("file").alias("n"), F.collect_set("m").alias("m"), F.collect_set("k").alias("k")).first()
            bloom = {"n_chunks_indexed": b.n, "m_bits": sorted(b.m), "k_hashes": sorted(b.k)}
        ids = [r.chunk_id for r in final]
        return {
            "where": where, "as_of": as_of, "normalized": P.normal(tree), "total_chunks": total, "candidates_count": len(ids), "pruning_ratio": len(ids) / total if total else 1.0,
            "candidates_by_col": by_column, "candidates_final": ids, "candidate_paths": [r.file for r in final], "candidates": ids, "count": len(ids),
            "indexes": {"minmax": {"n_chunks_indexed": total, **minmax}, "bloom": bloom, **{k: {"n_chunks_indexed": self.kind_rows(manifest, k).select("file").distinct().count()} for k in manifest.get("kinds", {})}},
        }

    def plan_plus(self, where: str | None = None) -> dict[str, Any]:
        """As ``plan``, with the candidates of each single condition."""
        manifest, tree = self.manifest(), P.parse(where)
        ids = [r.chunk_id for r in self._candidates(manifest, tree).select("chunk_id").orderBy("chunk_id").collect()]
        each = [{"pred": P.normal(t), "candidates": [r.chunk_id for r in self._candidates(manifest, t).select("chunk_id").orderBy("chunk_id").collect()]} for t in _tests(tree)]
        return {"candidates": ids, "count": len(ids), "explain": each, "normalized": P.normal(tree)}

    def inspect(self) -> dict[str, Any]:
        """Name, schema, layout, sizes, profile, usage and history of the table."""
        m = self.manifest()
        n, size, rows = self.stats(m).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        snaps, uses = self.list_snapshots(), self.store.names("meta/usage")
        return {
            "name": m["name"], "created_at": m["created_at"], "schema": m["schema"], "partitions": m["partitions"], "indexes": m["indexes"], "n_chunks": n, "bytes_total": size, "rows": rows,
            "quality": self.store.read_json("meta/profiles/quality.json"), "last_usage": self.store.read_json(f"meta/usage/{uses[-1]}") if uses else None,
            "usage_agg": self.store.read_json("meta/profiles/usage.json"), "snapshots": {"count": len(snaps), "last_ts": snaps[-1]["ts"] if snaps else None}, "journal": {"count": len(self.store.names("meta/journal"))},
        }

    # ------------------------------------------------------------ snapshots

    def snapshot(self, note: str | None = None) -> str:
        """Record the current files under the present time; returns the document's name.

        The document names the statistics that list the files, so its size doesn't grow with them.
        """
        m = self.manifest()
        ts = self.clock().astimezone(dt.UTC)
        name = f"{ts:%Y%m%dT%H%M%S%f}Z.json"
        doc = {
            "version": 1, "ts": ts.isoformat().replace("+00:00", "Z"), "manifest_hash": self.manifest_hash(m), "manifest": m["generation"],
            **self.listed(m), "profiles": {"quality": self.store.exists("meta/profiles/quality.json")}, "note": note,
        }
        self.store.write_json(f"meta/snapshots/{name}", doc)
        self.journal_append("snapshot", {"snapshot": name, "note": note})
        return name

    def listed(self, manifest: dict[str, Any]) -> dict[str, Any]:
        """What a snapshot says of its files: how many, and where they and their indexes are listed."""
        return {"n_chunks": manifest["chunks"], "parts": _stats_paths(manifest), "indexes": _index_paths(manifest)}

    def list_snapshots(self) -> list[dict[str, Any]]:
        """file, ts, chunks, indexes, note of each snapshot, oldest first."""
        out = []
        for name in self.store.names("meta/snapshots"):
            d = self.store.read_json(f"meta/snapshots/{name}")
            out.append({"file": f"snapshots/{name}", "ts": d["ts"], "chunks": d["n_chunks"] if "n_chunks" in d else len(d["chunks"]), "indexes": len(d["indexes"]), "note": d["note"]})
        return sorted(out, key=lambda d: d["ts"])

    def snapshot_files(self, as_of: str) -> DataFrame:
        """(chunk_id, path) of the newest snapshot's files not after ``as_of``."""
        return self.stats(self.manifest_as_of(as_of)).select("chunk_id", F.col("file").alias("path"))

    def resolve_as_of(self, token: str | None) -> str | None:
        """None and plain times as they are; ``latest`` and ``snapshots/x.json`` as their times (None if absent)."""
        if token is None:
            return None
        if token == "latest":
            snaps = self.list_snapshots()
            return snaps[-1]["ts"] if snaps else None
        if token.startswith("snapshots/"):
            d = self.store.read_json(f"meta/{token}")
            return d["ts"] if d else None
        return token

    def get_snapshot(self, as_of: str) -> dict[str, Any]:
        """The newest snapshot not after ``as_of``; ValueError for a bad time or none."""
        token = self.resolve_as_of(as_of)
        try:
            limit = dt.datetime.fromisoformat(str(token).replace("Z", "+00:00"))
        except ValueError:
            raise ValueError(f"invalid as_of: {as_of!r}") from None
        limit = limit if limit.tzinfo else limit.replace(tzinfo=dt.UTC)
        fit = [s for s in self.list_snapshots() if dt.datetime.fromisoformat(s["ts"].replace("Z", "+00:00")) <= limit]
        if not fit:
            raise ValueError(f"no snapshot at or before {as_of!r}")
        return self.store.read_json(f"meta/{fit[-1]['file']}")


def _stats_paths(manifest: dict[str, Any]) -> list[str]:
    return [manifest["stats"], *manifest.get("more_stats", [])]


def _index_paths(manifest: dict[str, Any]) -> list[str]:
    """Folders of a manifest's statistics and indexes."""
    m = manifest
    return [p for p in [*_stats_paths(m), m["bloom"], *m.get("more_blooms", []), *(p for paths in m.get("kinds", {}).values() for p in paths)] if p]


def _by_column(tests: list[P.Test]) -> dict[str, list[P.Test]]:
    out: dict[str, list[P.Test]] = {}
    for t in tests:
        out.setdefault(t.column, []).append(t)
    return out


def _asked(ask: Callable, t: P.Test, kind: T.DataType):
    """What an index says of one test; None where no index is asked."""
    v = [P.literal(x, kind) for x in t.values]
    if t.op == "null":
        return None
    if t.op == "in":
        return reduce(lambda a, b: a | b, [ask("=", x) for x in v])
    return ask(">=", v[0]) & ask("<=", v[1]) if t.op == "between" else ask(t.op, v[0])


def _tests(tree: P.Tree | None) -> list[P.Tree]:
    if tree is None:
        return []
    if isinstance(tree, (P.And, P.Or)):
        return [t for p in tree.parts for t in _tests(p)]
    return [tree]


def _only(tree: P.Tree | None, column: str) -> P.Tree | None:
    """The conjuncts that test one column alone."""
    if tree is None:
        return None
    if isinstance(tree, P.And):
        parts = tuple(p for p in tree.parts if P.columns_of(p) == [column])
        return P.And(parts) if len(parts) > 1 else parts[0] if parts else None
    return tree if P.columns_of(tree) == [column] else None
