"""Column encryption: AES-256-GCM per value, in Spark's own functions.

A key of its own for each column and call is derived from the passphrase's key; the
associated data binds a value to its table, column, generation of files, partition value and
row: the digest of the row's plaintext, or of those of its columns that are named as its key. Each manifest says how its own files are encrypted, so older snapshots stay readable. Keys reach the plan as a
scalar subquery over a one-row frame, so no plan text shows them. Spark draws the nonces.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import re
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..sources.table import Table


class WrongPassphrase(ValueError):
    """The passphrase is not the one the table was encrypted with."""


class CorruptCiphertext(ValueError):
    """A stored value does not authenticate."""


#: Cost of new tables' key derivation.
SCRYPT = {"n": 2**17, "r": 8, "p": 1}

#: Rows that a task encrypts; they take much longer than to be read, and a file may hold millions.
ROWS_A_TASK = 100_000


def derive_key(passphrase: str, salt: bytes, n: int, r: int, p: int) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=n, r=r, p=p, dklen=32, maxmem=2**28)


def _check(key: bytes, container: str) -> str:
    return hmac.new(key, f"check:{container}".encode(), hashlib.sha256).hexdigest()


def _key(table: Table, config: dict, passphrase: str) -> bytes:
    s = config["scrypt"]
    key = derive_key(passphrase, bytes.fromhex(s["salt"]), s["n"], s["r"], s["p"])
    if not hmac.compare_digest(_check(key, config["container_id"]), config["check"]):
        raise WrongPassphrase("wrong passphrase")
    return key


def _column_key(table: Table, config: dict, key: bytes, column: str) -> Column:
    sub = hmac.new(key, f"{config['container_id']}|{column}|{config['parts'][column]}".encode(), hashlib.sha256).digest()
    return table.spark.createDataFrame([(bytearray(sub),)], "k binary").scalar()


def _aad(config: dict, column: str, generation: Column, part: str | None) -> Column:
    own = F.lit(f"tally:{config['container_id']}|col:{column}")
    if config["aad_v"] < 3:
        return own
    value = F.coalesce(F.col(part).cast("string"), F.lit("\0")) if part else F.lit("")
    bound = [own, F.lit("|gen:"), generation.cast("string"), F.lit("|part:"), value]
    return F.concat(*bound, *([F.lit("|row:"), _row_digest(config["row_key"])] if config["aad_v"] > 3 else []))


#: Rows as text that doesn't depend on the session's settings.
EXACT = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd"}


def _row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), EXACT), 256) if columns else F.lit("")


def _generation() -> Column:
    """Number of the generation that a scanned row's file belongs to."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/data/gen-0*(\d+)/", 1)


def _to_text(column: Column, kind: T.DataType) -> Column:
    return F.to_json(F.struct(column.alias("v"))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else column.cast("string")


def _from_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(column, T.StructType([T.StructField("v", kind)]))["v"]
    return column.cast(kind)


def closed(df: DataFrame, table: Table, config: dict, columns: list[str], passphrase: str, generation: int, part: str | None) -> DataFrame:
    """``df`` with ``columns`` as ciphertext for files of one generation."""
    key = _key(table, config, passphrase)

    def close_value(c: str) -> Column:
        plain = _to_text(F.col(c), df.schema[c].dataType).cast("binary")
        return F.call_function("aes_encrypt", plain, _column_key(table, config, key, c), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _aad(config, c, F.lit(generation), part))

    return df.withColumns({c: close_value(c) for c in columns})


def _keyed(config: dict, schema: T.StructType) -> list[str]:
    """The plaintext columns that values are bound to."""
    return [c for c in (schema.names if config.get("row_named") is None else config["row_named"]) if c in schema.names and c not in config["columns"]]


def encrypt_columns(table: Table, columns: list[str], passphrase: str, scrypt: dict | None = None, row_key: list[str] | None = None) -> dict:
    """Rewrite the table, and every generation that a snapshot names, with ``columns`` as ciphertext; the plaintext files,
    their statistics and filters are deleted.

    Values are bound to the plaintext of their row: a value that is moved to a row with another plaintext, or whose
    row's plaintext is changed, doesn't authenticate. ``row_key`` names the columns that tell rows apart, so that
    reading an encrypted column needs these only; without, all plaintext columns are taken. Repeated calls add
    columns under the same passphrase; columns that are encrypted already are left, and a key is kept.
    Files that a snapshot and later ones share are rewritten once, and stay shared. Snapshots keep their times and rows and need the passphrase from then on. Readers that are still
    at work on the old files fail.
    """
    manifest, schema = table.manifest(), table.schema()
    config = table.crypto()
    for c in columns:
        if c not in schema.names:
            raise ValueError(f"no column to encrypt: {c}")
    if unknown := [c for c in row_key or [] if c not in schema.names or c in columns]:
        raise ValueError(f"no plaintext column for the row's key: {', '.join(unknown)}")
    if config:
        _key(table, config, passphrase)
        config = json.loads(json.dumps(config))
    else:
        cost = scrypt or SCRYPT
        salt = os.urandom(16)
        key = derive_key(passphrase, salt, cost["n"], cost["r"], cost["p"])
        config = {"version": 2, "algo": "AES-256-GCM", "kdf": "scrypt", "scrypt": {**cost, "salt": salt.hex()}, "nonce_size": 12, "aad_v": 4, "columns": [], "parts": {}, "kinds": {}, "container_id": uuid.uuid4().hex}
        config["check"] = _check(key, config["container_id"])
    new = [c for c in dict.fromkeys(columns) if c not in config["columns"]]
    if not new:
        return config
    if len(new) == len([c for c in schema.names if c not in config["columns"]]):
        raise ValueError("no plaintext column would be left")
    part = manifest["partitions"][0]["by"] if manifest["partitions"] else None
    if part in new:
        raise ValueError(f"the partition column can't be encrypted: {part}")
    config["parts"] |= {c: table.next_version() for c in new}
    config["kinds"] |= {c: schema[c].dataType.jsonValue() for c in new}
    config["columns"] = [*config["columns"], *new]
    config["aad_v"] = 4
    config["row_named"] = row_key if row_key is not None else config.get("row_named")
    config["row_key"] = _keyed(config, schema)
    with table.store.lock():
        if table.version() != manifest["generation"]:
            raise RuntimeError("the table changed meanwhile")
        table.store.write_json("meta/crypto.json", config)
        named = {}
        for s in table.list_snapshots():
            doc = table.store.read_json(f"meta/{s['file']}")
            named.setdefault(doc["manifest"], []).append((s["file"], doc))
        moved, olds = {}, {}
        for number in sorted({*named, manifest["generation"]}, key=lambda n: (n == manifest["generation"], n)):  # the current one last
            old = olds[number] = table.manifest(number)
            kept = T.StructType.fromJson(old["spark_schema"])
            own = [c for c in new if c in kept.names]
            by = old["partitions"][0]["by"] if old["partitions"] else None
            if by in own:
                raise ValueError(f"a snapshot is partitioned by {by}, which can't be encrypted")
            of_old = dict(old.get("crypto") or {})
            locked = [*of_old.get("columns", []), *own]
            mine = {**config, "part": by, "columns": locked, "parts": {c: of_old.get("parts", config["parts"])[c] if c in of_old.get("columns", []) else config["parts"][c] for c in locked}, "kinds": {c: kept[c].dataType.jsonValue() if c in own else of_old["kinds"][c] for c in locked}}
            mine["row_key"] = _keyed(mine, kept)
            base, files = next(((n, f) for n in sorted(moved, reverse=True) if (f := table.added(old, olds[n]))), (None, None))
            df, rows = table._scan(old, files), old["rows"] - (olds[base]["rows"] if base else 0)
            if of_old.get("columns"):  # values move to another generation
                df = decrypted(df, table, of_old["columns"], passphrase, of_old)
            if by and rows > ROWS_A_TASK:  # without a partition column, files keep their rows
                df = df.repartition(-(-rows // ROWS_A_TASK))
            df = closed(df, table, mine, locked, passphrase, table.next_version(), by)
            order = ["ts"] if "ts" in kept.names and "ts" not in locked else []
            indexes = {c: k for c, k in old["indexes"].items() if c not in locked}
            moved[number] = table._put(df, by, "encrypt", old=old, indexes=indexes, order=order, crypto=mine, details={"columns": own}, publish=number == manifest["generation"], onto=table.manifest(moved[base]) if base else None)
        for number, docs in named.items():
            fresh = table.manifest(moved[number])
            for name, doc in docs:
                doc.pop("chunks", None)  # of older versions: a list of the files
                table.store.write_json(f"meta/{name}", {**doc, "manifest": fresh["generation"], "manifest_hash": table.manifest_hash(fresh), **table.listed(fresh)})
        table.vacuum()
    table.snapshot(note="auto after encrypt")
    return config


def decrypted(df: DataFrame, table: Table, columns: list[str], passphrase: str, config: dict | None = None) -> DataFrame:
    """Scanned rows ``df`` with ``columns`` in the clear. A value that doesn't authenticate fails the job as CorruptCiphertext's text."""
    config = config or table.crypto()
    key = _key(table, config, passphrase)
    part = config.get("part")
    df = df.withColumn("__gen", _generation()) if config["aad_v"] > 2 else df

    def open_value(c: str) -> Column:
        kind = T._parse_datatype_json_value(config["kinds"][c])
        plain = F.call_function("try_aes_decrypt", F.col(c), _column_key(table, config, key, c), F.lit("GCM"), F.lit("DEFAULT"), _aad(config, c, F.col("__gen"), part))
        # named once, so that no value is opened twice
        plain = F.coalesce(plain, F.raise_error(F.lit(f"CorruptCiphertext: {c}")).cast("binary"))
        return F.when(F.col(c).isNotNull(), _from_text(plain.cast("string"), kind))

    return df.withColumns({c: open_value(c) for c in columns}).drop("__gen")


def check_values(table: Table, passphrase: str) -> None:
    """Open every encrypted value of the current files; CorruptCiphertext names the columns with values that don't authenticate."""
    config = table.crypto()
    if not config:
        return
    df = decrypted(table._scan(table.manifest()), table, config["columns"], passphrase)
    try:
        df.select(*config["columns"]).write.format("noop").mode("overwrite").save()
    except Exception as e:
        if found := re.search(r"CorruptCiphertext: \S+", str(e)):
            raise CorruptCiphertext(found[0]) from None
        raise


def decrypt_columns(table: Table, columns: list[str], passphrase: str) -> dict | None:
    """Rewrite the table with ``columns`` (none given: all) in the clear again."""
    config, manifest = table.crypto(), table.manifest()
    if not config:
        raise ValueError("the table is not encrypted")
    gone = list(columns) or list(config["columns"])
    for c in gone:
        if c not in config["columns"]:
            raise ValueError(f"not encrypted: {c}")
    left = [c for c in config["columns"] if c not in gone]
    df = decrypted(table._scan(manifest), table, config["columns"], passphrase)
    part = manifest["partitions"][0]["by"] if manifest["partitions"] else None
    config = config | {"columns": left, "parts": {c: config["parts"][c] for c in left}, "kinds": {c: config["kinds"][c] for c in left}}
    with table.store.lock():
        if table.version() != manifest["generation"]:
            raise RuntimeError("the table changed meanwhile")
        if left:
            df = closed(df, table, config, left, passphrase, table.next_version(), part)
        table._put(df, part, "decrypt", old=manifest, order=["ts"] if "ts" in df.columns and "ts" not in left else [], crypto=config if left else None, details={"columns": gone})
        if left:
            table.store.write_json("meta/crypto.json", config)
        else:
            table.store.delete("meta/crypto.json")
    table.snapshot(note="auto after decrypt")
    return config if left else None
