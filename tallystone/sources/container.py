"""Zip containers as a Spark data source: Parquet chunks, indexes, snapshots and encrypted columns in one zip file.

A container holds ``manifest.json``, ``chunks/[<col>=<value>/]part-NNNNNN.parquet``, ``indexes/``,
``snapshots/``, ``enc/part-NNNNNN/<column>.bin``, ``config/`` and ``signatures/``. The driver reads central directories and
small documents; chunks are partitions of a data source, read by tasks row group by row group.
Before anything is read, the envelope is checked: a file must be one zip from its first byte to
its last, without a comment, with safe and different names, and within limits of size and ratio.
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..functions import ed25519
from ..operators import audit, integrity
from ..operators.encrypt import CorruptCiphertext, WrongPassphrase, derive_key
from ..plans import predicate as P
from .files import dealt, local_path, open_binary, sha256_of, tasks_over

#: Entries up to this size are unpacked in memory; larger ones are read as streams, row group by row group.
HELD = 64 << 20
#: Regions that a signature leaves out, and where it stands (fixed values of the format).
UNSIGNED = ("signatures/", "profiles/audit/", "profiles/usage/")
UNSIGNED_NAMES = ("profiles/usage.json",)
SIGNATURE, CRYPTO, AUDIT = "signatures/ed25519.json", "config/crypto.json", "profiles/audit/"


class EnvelopeError(ValueError):
    """A container that is not exactly one plain zip, or is beyond the limits."""


@dataclass(frozen=True)
class Limits:
    """Bytes of an entry and of all, and how many times its packed size an entry may have."""

    entry: int = 2 << 30
    total: int = 8 << 30
    ratio: float = 200.0


def is_signed(name: str) -> bool:
    return not name.endswith("/") and not name.startswith(UNSIGNED) and name not in UNSIGNED_NAMES


class Container:
    """An open container whose envelope holds; close it, or use it in a ``with``."""

    def __init__(self, path: str, limits: Limits = Limits()):
        self.path, self.file = path, open_binary(path)
        try:
            self.zip = zipfile.ZipFile(self.file)
            problems = self.problems(limits)
        except zipfile.BadZipFile as e:
            self.file.close()
            raise EnvelopeError(f"refused: {path}: {e}") from None
        if problems:
            self.close()
            raise EnvelopeError(f"refused: {path}: {'; '.join(problems)}")

    def __enter__(self) -> Container:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.zip.close()
        self.file.close()

    def problems(self, limits: Limits) -> list[str]:
        """What is wrong with the envelope, by the central directory and the file's ends alone."""
        out, infos = [], self.zip.infolist()
        names = [i.filename for i in infos]
        if len(set(names)) < len(names):
            out.append(f"duplicate entry: {next(n for i, n in enumerate(names) if n in names[:i])}")
        out += [f"unsafe name: {n}" for n in names if n.startswith("/") or "\\" in n or ".." in n.split("/")]
        if self.zip.comment:
            out.append(f"{len(self.zip.comment)} bytes of comment, which nothing signs")
        if infos and (first := min(i.header_offset for i in infos)):
            out.append(f"{first} bytes before the first entry")
        self.file.seek(0, io.SEEK_END)
        end = self.file.tell()
        self.file.seek(max(0, end - 22 - len(self.zip.comment)))
        if self.file.read(4) != b"PK\x05\x06":
            out.append("bytes after the end of the directory")
        for i in infos:
            if i.file_size > limits.entry:
                out.append(f"size limit: {i.filename} has {i.file_size} bytes of {limits.entry}")
            if i.compress_size and i.file_size > i.compress_size * limits.ratio:
                out.append(f"compression ratio limit: {i.filename} has {i.file_size} bytes of {i.compress_size} packed, more than {limits.ratio:g} times")
        if (total := sum(i.file_size for i in infos)) > limits.total:
            out.append(f"size limit: {total} bytes in all of {limits.total}")
        return out

    def names(self, folder: str = "") -> list[str]:
        return [n for n in self.zip.namelist() if n.startswith(folder) and not n.endswith("/")]

    def size(self, name: str) -> int:
        return self.zip.getinfo(name).file_size

    def json(self, name: str, default: Any = None) -> Any:
        return json.loads(self.zip.read(name)) if name in self.zip.namelist() else default

    def parquet(self, name: str) -> pq.ParquetFile:
        """An entry as a Parquet file. zipfile gives no more bytes than the directory declares, and checks the entry's sum."""
        if self.size(name) <= HELD:
            return pq.ParquetFile(io.BytesIO(self.zip.read(name)))
        return pq.ParquetFile(self.zip.open(name), pre_buffer=False)


def paths_of(path: str) -> list[str]:
    """One container, or all that a pattern with ``*`` finds on a mounted store."""
    plain = local_path(path)
    if "*" not in path or plain is None:
        return [path]
    found = sorted(glob.glob(plain))
    if not found:
        raise FileNotFoundError(path)
    return found


# ---------------------------------------------------------------- data source


@dataclass
class Chunk(InputPartition):
    path: str
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.chunks = [tuple(x) for x in json.loads(options["chunks"])]  # (container, entry, bytes)
        self.limits, self.bins = Limits(*json.loads(options["limits"])), int(options["tasks"])

    def partitions(self) -> list[Chunk]:
        out = []
        by_path: dict[str, list[tuple[str, int]]] = {}
        for path, name, size in self.chunks:
            by_path.setdefault(path, []).append((name, size))
        total = sum(s for _, _, s in self.chunks) or 1
        for path, named in by_path.items():
            share = sum(s for _, s in named) / total
            out += [Chunk(path, names) for names in dealt(named, max(1, round(self.bins * share)))]
        return out or [Chunk("", [])]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.names:
            return
        fields = {f.name: f for f in to_arrow_schema(self.schema)}
        own = [c for c in fields if not c.startswith("__")]
        with Container(partition.path, self.limits) as c:
            for name in partition.names:
                file, row = c.parquet(name), 0
                there = [x for x in own if x in file.schema_arrow.names]
                for group in range(file.num_row_groups):
                    rows = file.metadata.row_group(group).num_rows
                    table = file.read_row_group(group, columns=there, use_threads=False)
                    for start in range(0, max(rows, 1), 1 << 16):
                        part = table.slice(start, 1 << 16)
                        n = min(rows - start, 1 << 16)
                        columns = [part.column(x).cast(fields[x].type, safe=False) if x in there else pa.nulls(n, fields[x].type) for x in own]
                        made = {"__container": [partition.path] * n, "__entry": [name] * n, "__row": range(row + start, row + start + n)}
                        columns += [pa.array(made[x], fields[x].type) for x in fields if x.startswith("__")]
                        named = [*own, *[x for x in fields if x.startswith("__")]]
                        yield from pa.Table.from_arrays(columns, names=named).select(list(fields)).combine_chunks().to_batches()
                    row += rows


class ZipContainers(DataSource):
    """``spark.read.format("zip_container")``; ``read_container`` fills in its options."""

    @classmethod
    def name(cls) -> str:
        return "zip_container"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def _schema(spark: SparkSession, chunks: list[tuple[str, str, int]], limits: Limits) -> T.StructType:
    """The columns of all chunks; types that differ are widened, columns that some lack are null there."""

    def footer(key: str) -> list[tuple]:
        path, name = json.loads(key)
        with Container(path, limits) as c:
            return [(c.parquet(name).schema_arrow.remove_metadata().serialize().to_pybytes(),)]

    found = tasks_over(spark, [(json.dumps(c[:2]), c[2]) for c in chunks], footer, "raw binary", [pa.binary()]).groupBy("raw").agg(F.count("*")).select("raw").collect()  # few distinct ones
    schemas = sorted((pa.ipc.read_schema(pa.py_buffer(r.raw)) for r in found), key=lambda s: -len(s.names))
    merged = pa.unify_schemas(schemas, promote_options="permissive") if schemas else pa.schema([])
    plain = [pa.field(f.name, pa.string() if pa.types.is_null(f.type) else f.type) for f in merged if not re.fullmatch(r"__index_level_\d+__", f.name)]
    return from_arrow_schema(pa.schema(plain), prefer_timestamp_ntz=True)


def _when(text: str) -> dt.datetime:
    at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


def _chunks(c: Container, as_of: str | None) -> list[str]:
    """The chunks of now, or of the newest snapshot not after ``as_of``."""
    if as_of is None:
        return [n for n in c.names("chunks/") if n.endswith(".parquet")]
    try:
        limit = _when(as_of)
    except ValueError:
        raise ValueError(f"invalid as_of: {as_of!r}") from None
    fit = [s for s in (c.json(n) for n in c.names("snapshots/")) if _when(s["ts"]) <= limit]
    if not fit:
        raise ValueError(f"no snapshot at or before {as_of!r} in {c.path}")
    return [e["path"] for e in max(fit, key=lambda s: _when(s["ts"]))["chunks"]]


def _bounds(c: Container, columns: list[str]) -> dict[str, dict[str, tuple[Any, Any]]]:
    """column -> entry -> (min, max) of the container's own indexes."""
    out: dict[str, dict[str, tuple[Any, Any]]] = {}
    for name in c.names("indexes/"):
        if name.endswith(".minmax.json") and (doc := c.json(name)).get("column") in columns:
            out[doc["column"]] = {e["path"]: (e["min"], e["max"]) for e in doc.get("entries", []) if e.get("min") is not None and e.get("max") is not None}
    return out


def _pruned(spark: SparkSession, chunks: list[tuple[str, str, int]], bounds: dict[str, dict[str, dict[str, tuple[Any, Any]]]], tree: P.Tree, schema: T.StructType) -> list[tuple[str, str, int]]:
    """The chunks that may hold a match, by the containers' indexes; a chunk that an index doesn't know stays."""
    columns = sorted({c for of in bounds.values() for c in of} & set(schema.names))
    if not columns or not chunks:
        return chunks
    text = lambda v: None if v is None else str(v)
    rows = [(path, name, size, *[text(x) for c in columns for x in bounds.get(path, {}).get(c, {}).get(name, (None, None))]) for path, name, size in chunks]
    kinds = "path string, name string, size long, " + ", ".join(f"`{e}_{c}` string" for c in columns for e in ("min", "max"))
    index = spark.createDataFrame(rows, kinds)

    def bound(c: str, end: str) -> Column:
        kind, text = schema[c].dataType, F.col(f"{end}_{c}")
        if not isinstance(kind, T.IntegralType):
            return text.try_cast(kind)
        about = text.try_cast("double")  # the format keeps whole numbers as floats too
        return F.floor(about - F.abs(about) * 1e-15) if end == "min" else F.ceil(about + F.abs(about) * 1e-15)

    unknown = F.lit(None).cast("long")
    known = index.withColumns({f"{e}_{c}": bound(c, e) for c in columns for e in ("min", "max")}).withColumns({**{f"nulls_{c}": unknown for c in columns}, "rows": unknown})
    return [(r.path, r.name, r["size"]) for r in known.where(P.may_match(tree, schema, columns)).select("path", "name", "size").collect()]


def read_container(
    spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, as_of: str | None = None, head: int | None = None, passphrase: str | None = None, limits: Limits = Limits(), tasks: int | None = None
) -> DataFrame:
    """Rows of a container, or of all that a pattern finds, which match ``where``: chunks pruned by the containers' indexes, columns read as asked.

    All columns where ``columns`` is None; ``head`` keeps the first rows by container, entry and row.
    Encrypted columns that are asked for or tested need the passphrase; without it they are left out.
    An envelope that doesn't hold, a bad time or an unknown column is an error before any row is read.
    """
    spark.dataSource.register(ZipContainers)
    tree = P.parse(where)
    chunks, bounds, locked = [], {}, {}
    for p in paths_of(path):
        with Container(p, limits) as c:
            chunks += [(p, n, c.size(n)) for n in _chunks(c, as_of)]
            bounds[p] = _bounds(c, P.columns_of(tree))
            if config := c.json(CRYPTO):
                locked[p] = (config, [n for n in c.names("enc/") if n.endswith(".bin")])
    plain = _schema(spark, chunks, limits)
    hidden = {n.rsplit("/", 1)[1].removesuffix(".bin") for _, names in locked.values() for n in names}
    tested = P.columns_of(tree)
    if columns is None:
        columns = [*plain.names, *sorted(hidden - set(plain.names) if passphrase is not None else [])]
    for x in [*columns, *tested]:
        if x not in plain.names and x not in hidden:
            raise ValueError(f"unknown column: {x}")
    need = sorted(hidden & {*columns, *tested})
    if need and passphrase is None:
        raise ValueError(f"encrypted columns need a passphrase: {', '.join(need)}")
    if tree is not None and not set(tested) & hidden:
        chunks = _pruned(spark, chunks, bounds, tree, plain)
    wanted = [x for x in dict.fromkeys([*columns, *tested]) if x in plain.names]
    places = T.StructType([T.StructField("__container", T.StringType()), T.StructField("__entry", T.StringType()), T.StructField("__row", T.LongType())])
    schema = T.StructType([plain[x] for x in wanted] + (places.fields if need or head is not None or not wanted else []))
    options = {"chunks": json.dumps(chunks), "limits": json.dumps([limits.entry, limits.total, limits.ratio]), "tasks": str(tasks or 2 * spark.sparkContext.defaultParallelism)}
    df = spark.read.format("zip_container").schema(schema).options(**options).load()
    for x in need:
        df = _with_locked(spark, df, x, locked, passphrase, limits, {(p, n) for p, n, _ in chunks})
    if tree is not None:
        df = df.where(P.condition(tree, T.StructType([df.schema[x] for x in df.columns])))
    if head is not None:
        df = df.orderBy("__container", "__entry", "__row").limit(head)
    return df.select(*columns)


# ---------------------------------------------------------------- encrypted columns


def _part_of(entry: str | Column) -> Any:
    return re.search(r"part-(\d+)\.(?:parquet)$", entry)[1] if isinstance(entry, str) else F.regexp_extract(entry, r"part-(\d+)\.parquet$", 1)


def _key(spark: SparkSession, config: dict, passphrase: str) -> bytes:
    s = config["scrypt"]
    key = derive_key(passphrase, bytes.fromhex(s["salt"]), s["n"], s["r"], s["p"])
    if check := config.get("check"):
        sealed = spark.createDataFrame([(bytearray(bytes.fromhex(check["nonce"] + check["ct"])), bytearray(key), bytearray(f"sf-check:{config['container_id']}".encode()))], "c binary, k binary, a binary")
        if sealed.select(F.call_function("try_aes_decrypt", "c", "k", F.lit("GCM"), F.lit("DEFAULT"), "a")).first()[0] is None:
            raise WrongPassphrase("wrong passphrase")
    return key


def _with_locked(spark: SparkSession, df: DataFrame, column: str, locked: dict, passphrase: str, limits: Limits, chunks: set[tuple[str, str]]) -> DataFrame:
    """``df`` with an encrypted column: its sidecars are opened by Spark's AES, one a chunk, and joined by the rows' places."""
    keys, items = [], []
    parts = {(p, _part_of(n)): n for p, n in chunks}
    for p, (config, names) in locked.items():
        keys.append((p, bytearray(_key(spark, config, passphrase)), config.get("container_id") if config.get("aad_v", 1) >= 2 else None))
        items += [(json.dumps([p, n]), 1) for n in names if n.endswith(f"/{column}.bin") and (p, n.split("/")[1].removeprefix("part-")) in parts]

    def sealed(key: str) -> list[tuple]:
        path, name = json.loads(key)
        with Container(path, limits) as c:
            return [(path, name.split("/")[1].removeprefix("part-"), c.zip.read(name))]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, part, raw in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if raw is None:
                    raise CorruptCiphertext(f"{path}: column {column} of part {part} doesn't authenticate")
                values = pq.read_table(io.BytesIO(raw)).column(column).cast(kind)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array([part] * len(values)), pa.array(range(len(values)), pa.int64()), values.combine_chunks()], names=["__path", "__part", "__at", column])

    raw = tasks_over(spark, items, sealed, "__path string, __part string, sealed binary", [pa.string(), pa.string(), pa.binary()])
    known = spark.createDataFrame(keys, "__path string, k binary, own string")
    of_part = F.concat(F.lit("part:"), "__part", F.lit(f"|col:{column}"))
    aad = F.when(F.col("own").isNull(), of_part).otherwise(F.concat(F.lit("sf:"), "own", F.lit("|"), of_part)).cast("binary")
    content = raw.join(F.broadcast(known), "__path").select("__path", "__part", F.call_function("try_aes_decrypt", "sealed", "k", F.lit("GCM"), F.lit("DEFAULT"), aad).alias("content"))
    kinds = content.mapInArrow(_kind_of(column), "kind binary").distinct().collect()  # few
    merged = pa.unify_schemas([pa.ipc.read_schema(pa.py_buffer(r.kind)) for r in kinds], promote_options="permissive") if kinds else pa.schema([(column, pa.string())])
    kind = merged.field(0).type if not pa.types.is_null(merged.field(0).type) else pa.string()
    shown = from_arrow_schema(pa.schema([(column, kind)]), prefer_timestamp_ntz=True)[column].dataType.simpleString()
    values = content.mapInArrow(opened, f"__path string, __part string, __at long, `{column}` {shown}")
    placed = df.drop(column).withColumn("__own", _part_of(F.col("__entry")))
    return placed.join(values, (F.col("__container") == F.col("__path")) & (F.col("__own") == F.col("__part")) & (F.col("__row") == F.col("__at")), "left").drop("__path", "__part", "__at", "__own")


def _kind_of(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, part, raw in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if raw is None:
                    raise CorruptCiphertext(f"{path}: column {column} of part {part} doesn't authenticate")
                out.append(pa.schema([pq.read_schema(io.BytesIO(raw)).field(column)]).remove_metadata().serialize().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["kind"])

    return run


# ---------------------------------------------------------------- integrity


def container_digests(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(name, bytes, digest) of every signed entry, unpacked and hashed as a stream in tasks that have about the same bytes."""
    with Container(path, limits) as c:
        items = [(n, c.size(n)) for n in c.names() if is_signed(n)]

    def digest(name: str) -> list[tuple]:
        with Container(path, limits) as c:
            try:
                with c.zip.open(name) as stream:
                    return [(name, c.size(name), sha256_of(stream))]
            except (zipfile.BadZipFile, EOFError, struct.error, OSError):  # a sum that doesn't fit its entry
                return [(name, c.size(name), "unreadable")]

    return tasks_over(spark, items, digest, "name string, bytes long, digest string", [pa.string(), pa.int64(), pa.string()])


def audit_lines(spark: SparkSession, c: Container) -> DataFrame:
    """(file, line_no, line) of the container's audit log; a day's file is one entry."""
    rows = [(n.rsplit("/", 1)[1], i + 1, line) for n in c.names(AUDIT) if n.endswith(".jsonl") for i, line in enumerate(x for x in c.zip.read(n).decode("utf-8", "replace").split("\n") if x)]
    return spark.createDataFrame(rows, "file string, line_no int, line string")


def verify_container(spark: SparkSession, path: str, public_hex: str | None = None, limits: Limits = Limits()) -> dict[str, Any]:
    """Whether a container is what its signature says: valid, reason, signer, signed_at, trusted_key, modified, missing, added, audit. Damaged input never raises."""
    report: dict[str, Any] = {"valid": False, "reason": "", "signer": None, "signed_at": None, "trusted_key": False, "modified": [], "missing": [], "added": [], "audit": {"consistent": None}}
    try:
        with Container(path, limits) as c:
            try:
                doc = c.json(SIGNATURE)
            except ValueError:
                doc = {}
            lines = audit_lines(spark, c) if c.names(AUDIT) else None
    except EnvelopeError as e:
        return report | {"reason": str(e)}
    except OSError as e:
        return report | {"reason": f"container unreadable: {type(e).__name__}"}
    if doc is None:
        return report | {"reason": "unsigned: no signature"}
    payload = doc.get("payload") if isinstance(doc, dict) else None
    if not isinstance(payload, dict) or not isinstance(doc.get("signature"), str) or not isinstance(payload.get("entries"), dict) or not isinstance(payload.get("public_key"), str):
        return report | {"reason": "invalid signature: malformed document"}
    report |= {"signer": payload.get("signer"), "signed_at": payload.get("signed_at"), "trusted_key": public_hex is not None and payload["public_key"] == public_hex}
    try:
        if not ed25519.verify(public_hex or payload["public_key"], integrity.canonical(payload), doc["signature"]):
            return report | {"reason": "invalid signature: it does not match the key"}
    except ValueError:
        return report | {"reason": "invalid signature: malformed document"}
    was, now = payload["entries"], {r.name: r.digest for r in container_digests(spark, path, limits).select("name", "digest").collect()}  # the signature lists them all
    report |= {"missing": sorted(was.keys() - now.keys()), "added": sorted(now.keys() - was.keys()), "modified": sorted(n for n in was.keys() & now.keys() if was[n] != now[n])}
    changed = [len(report[k]) for k in ("modified", "missing", "added")]
    if any(changed) or integrity.root_of(was) != payload.get("entries_root"):
        return report | {"reason": f"tampering detected: {changed[0]} modified {'entry' if changed[0] == 1 else 'entries'}, {changed[1]} missing, {changed[2]} added"}
    if lines is not None:
        bad = [r.file for r in audit.first_bad(lines).where("first_bad_line is not null").collect()]  # a row a day
        report["audit"] = {"consistent": not bad}
        if bad:
            return report | {"reason": "tampering detected: audit log rewritten"}
    return report | {"valid": True, "reason": "ok"}


# ---------------------------------------------------------------- export


def write_containers(df: DataFrame, folder: str, partition_by: str | None = None, rows_per_chunk: int = 100_000) -> DataFrame:
    """Write ``df`` as containers in a folder that tasks can open, one a task, and return (path, chunks, rows) of each.

    Chunks hold one value of ``partition_by`` and at most so many rows; the columns of each have a min/max
    index. A container appears under its name only when it is complete, so a repeated task does no harm.
    """
    import os
    import uuid

    where = local_path(folder)
    if where is None:
        raise ValueError(f"tasks can't write to {folder}")
    os.makedirs(where, exist_ok=True)
    indexed = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.TimestampType, T.TimestampNTZType))]
    run_id = uuid.uuid4().hex

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, pa.Table]]:
        """Rows of one value in a row, as tables of at most ``rows_per_chunk``."""
        held, n, value = [], 0, ()
        for b in batches:
            keys = b.column(partition_by).to_pylist() if partition_by else [None] * b.num_rows
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, z in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                while a < z:
                    if held and ((keys[a],) != value or n >= rows_per_chunk):
                        yield value[0], pa.Table.from_batches(held)
                        held, n = [], 0
                    take = min(z - a, rows_per_chunk - n)
                    held.append(b.slice(a, take))
                    value, n, a = (keys[a],), n + take, a + take
        if held:
            yield value[0], pa.Table.from_batches(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        final = f"{where}/container-{run_id[:8]}-{task:06d}.zip"
        temp, entries, rows, names = f"{where}/.{uuid.uuid4().hex}.tmp", {c: [] for c in indexed}, 0, []
        try:
            with zipfile.ZipFile(temp, "w", zipfile.ZIP_DEFLATED) as z:
                for i, (value, table) in enumerate(chunks(batches)):
                    sub = f"{partition_by}={'__NULL__' if value is None else value}/" if partition_by else ""
                    name = f"chunks/{re.sub(r'[^\w=./-]', '_', sub).replace('..', '_')}part-{i:06d}.parquet"
                    buffer = io.BytesIO()
                    pq.write_table(table, buffer, compression="zstd")
                    z.writestr(name, buffer.getvalue())
                    names.append(name)
                    rows += table.num_rows
                    for c in indexed:
                        low, high = pa.compute.min_max(table.column(c)).as_py().values()
                        if low is not None:
                            entries[c].append({"chunk_id": f"{i:06d}", "path": name, "min": _plain(low), "max": _plain(high)})
                for c in indexed:
                    z.writestr(f"indexes/{c}.minmax.json", json.dumps({"version": 1, "column": c, "index": "minmax", "entries": entries[c]}, ensure_ascii=False))
                z.writestr("manifest.json", json.dumps({"version": 1, "name": f"container-{task}", "schema": kinds, "primary_key": None, "partitions": [{"by": partition_by}] if partition_by else [], "indexes": {c: ["minmax"] for c in indexed}}, ensure_ascii=False))
            os.replace(temp, final)
        finally:
            if os.path.exists(temp):
                os.remove(temp)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([len(names)], pa.int64()), pa.array([rows], pa.int64())], names=["path", "chunks", "rows"])

    from .table import arrow_type

    kinds = [{"name": f.name, "arrow_type": arrow_type(f.dataType)} for f in df.schema]
    dealt_rows = df.sortWithinPartitions(partition_by) if partition_by else df
    return df.sparkSession.createDataFrame(dealt_rows.mapInArrow(write, "path string, chunks long, rows long").collect(), "path string, chunks long, rows long")  # a row a container


def _plain(value: Any) -> Any:
    return value.isoformat() if isinstance(value, (dt.datetime, dt.date)) else value if isinstance(value, (int, float, str)) else str(value)
