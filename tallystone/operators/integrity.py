"""Digests, root, signature and verification of a table's files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ed25519
from ..sources import files
from . import audit as A

if TYPE_CHECKING:
    from ..sources.table import Table

SIGNATURE = "meta/signature.json"
UNSIGNED = ("meta/signature.json", "meta/receipt.json", "meta/audit/", "meta/usage/", "meta/profiles/usage.json", "meta/.")
#: Verifier limits: bytes of a file and of all files. Files are hashed as streams, so their size costs no memory.
MAX_ENTRY, MAX_TOTAL = 1 << 50, 1 << 60


def canonical(doc: Any) -> bytes:
    """JSON with sorted keys and no spaces."""
    return json.dumps(doc, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()


def entry_digests(table: Table, max_entry: int = MAX_ENTRY, max_total: int = MAX_TOTAL) -> DataFrame:
    """(name, bytes, digest) of every signed file. Sizes are checked before any content is read.

    Files are dealt to tasks by bytes, and each is hashed as a stream from where it lies. On a store
    that Python workers can't open, Spark's reader takes a file as one value, of 2 GiB at most.
    """
    names = [(n, size) for n, size in table.store.files() if not n.startswith(UNSIGNED)]
    bad = [n for n, _ in names if "\\" in n or n.startswith("/") or ".." in n.split("/")]
    if bad:
        raise ValueError(f"unsafe structure: {bad[0]}")
    if any(size > max_entry for _, size in names) or sum(size for _, size in names) > max_total:
        raise ValueError("refused: size limits exceeded")
    base = table.store.uri().rstrip("/")
    if not files.can_open(base):
        return _digests_by_spark(table, names)

    def digest(name: str) -> list[tuple]:
        try:
            with files.open_binary(f"{base}/{name}") as stream:
                found = files.sha256_of(stream)
                return [(name, stream.tell(), found)]
        except OSError:  # listed with another digest, and so modified
            return [(name, None, hashlib.sha256(b"unreadable").hexdigest())]

    return files.tasks_over(table.spark, names, digest, "name string, bytes long, digest string", [pa.string(), pa.int64(), pa.string()])


def _digests_by_spark(table: Table, names: list[tuple[str, int]]) -> DataFrame:
    if not names:
        return table.spark.createDataFrame([], "name string, bytes long, digest string")
    base = table.store.uri().rstrip("/") + "/"
    # a file whose read fails (a store's own checksum, say) is listed without a digest, and so counts as modified
    content = table.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(table.path)
    name = F.substring_index(F.regexp_replace("path", "^file:/+", "file:/"), base.replace("file:///", "file:/"), -1)
    hashed = content.select(name.alias("name"), F.sha2("content", 256).alias("digest"))
    # Spark's readers pass over hidden files (markers of finished jobs): these are hashed here
    hidden = [(n, size, hashlib.sha256(table.store.read_bytes(n)).hexdigest()) for n, size in names if any(x.startswith(("_", ".")) and "=" not in x for x in n.split("/"))]
    seen = {n for n, _, _ in hidden}
    listed = table.spark.createDataFrame([x for x in names if x[0] not in seen], "name string, bytes long")
    out = listed.join(hashed, "name", "left").select("name", "bytes", F.coalesce("digest", F.sha2(F.lit("unreadable"), 256)).alias("digest"))
    return out.union(table.spark.createDataFrame(hidden, "name string, bytes long, digest string")) if hidden else out


def root_of(entries: dict[str, str]) -> str:
    """sha256 over the concatenated sha256(name) and digest of all entries, by name."""
    h = hashlib.sha256()
    for name in sorted(entries):
        h.update(hashlib.sha256(name.encode()).digest() + bytes.fromhex(entries[name]))
    return h.hexdigest()


def entries_root(entries: DataFrame, by: str | None = None, name: str = "name", digest: str = "digest") -> DataFrame:
    """(by, root, count) of each group, or (root, count) of all: what ``root_of`` gives, from the sorted rows.

    One hash over all entries has one order, so a group passes through one task; it does so as a
    sorted stream of two digests a row, which spills and is never held.
    """
    key = F.col(by).cast("string") if by else F.lit("")
    rows = entries.select(key.alias("by"), F.col(name).cast("string").alias("name"), F.unhex(F.concat(F.sha2(F.col(name).cast("string"), 256), F.col(digest))).alias("both"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, h, n, out = (), None, 0, []
        for b in batches:
            for g, both in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (g,) != group:
                    if group:
                        out.append((*group, h.hexdigest(), n))
                    group, h, n = (g,), hashlib.sha256(), 0
                h.update(both)
                n += 1
        if group:
            out.append((*group, h.hexdigest(), n))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["by", "root", "count"])

    made = rows.repartition("by").sortWithinPartitions("by", "name").select("by", "both").mapInArrow(run, "by string, root string, count long")
    return made.select(F.col("by").cast(entries.schema[by].dataType).alias(by), "root", "count") if by else made.select("root", "count")


def entry_diff(signed: DataFrame, current: DataFrame) -> DataFrame:
    """(name, status): missing, added or modified between two sets of (name, digest)."""
    s, c = signed.select("name", F.col("digest").alias("was")), current.select("name", F.col("digest").alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "modified")
    return s.join(c, "name", "full_outer").select("name", status.alias("status")).where("status is not null")


def _each_once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    """An object of a document in which no name is given twice."""
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a name is given twice")
    return out


def sign_table(table: Table, private_hex: str, signer: str | None = None) -> dict[str, Any]:
    """Sign the files' digests and the audit heads; the signature is a document of its own, so no file is rewritten."""
    chain = A.verify(table)
    if not chain["ok"]:
        raise ValueError(f"refusing to sign: inconsistent audit chain {chain['bad']}")
    entries = dict(sorted((r.name, r.digest) for r in entry_digests(table).collect()))  # the signature lists them all
    payload = {
        "v": 1, "alg": "ed25519", "entries_root": root_of(entries), "entry_count": len(entries), "entries": entries, "audit_heads": A.heads(table),
        "signer": signer, "signed_at": table.now(), "public_key": ed25519.keypair_of(private_hex).public_hex,
    }
    doc = {"payload": payload, "signature": ed25519.sign(table.spark, private_hex, canonical(payload))}
    table.store.write_json(SIGNATURE, doc)
    return doc


def verify_table(table: Table, public_hex: str | None = None, allow_unattested_appends: bool = False) -> dict[str, Any]:
    """The verification report; it never raises on damaged input."""
    report: dict[str, Any] = {"valid": False, "reason": "", "signer": None, "signed_at": None, "trusted_key": False, "modified": [], "missing": [], "added": [], "audit": {"consistent": None, "append_only": None, "unattested_appends": 0, "detail": {}}}
    try:
        try:
            doc = json.loads(table.store.read_text(SIGNATURE), object_pairs_hook=_each_once) if table.store.exists(SIGNATURE) else None
        except ValueError:
            doc = {}
        if doc is None:
            return report | {"reason": "unsigned: no signature"}
        payload = doc.get("payload") if isinstance(doc, dict) else None
        if not isinstance(payload, dict) or not isinstance(doc.get("signature"), str) or not isinstance(payload.get("entries"), dict) or not isinstance(payload.get("public_key"), str):
            return report | {"reason": "invalid signature: malformed document"}
        report |= {"signer": payload.get("signer"), "signed_at": payload.get("signed_at")}
        report["trusted_key"] = public_hex is not None and payload["public_key"] == public_hex
        if not ed25519.verify(public_hex or payload["public_key"], canonical(payload), doc["signature"]):
            return report | {"reason": "invalid signature: it does not match the key"}
        try:
            current = entry_digests(table)
        except ValueError as e:
            return report | {"reason": str(e) if str(e).startswith("refused") else f"unsafe structure: {e}"}
        # the signature's entries are in memory already, and one job hashes the files
        was, now = payload["entries"], {r.name: r.digest for r in current.select("name", "digest").collect()}
        report |= {"missing": sorted(was.keys() - now.keys()), "added": sorted(now.keys() - was.keys()), "modified": sorted(n for n in was.keys() & now.keys() if was[n] != now[n])}
        root = root_of(was)
        chain, since = {"ok": True}, {"append_only": True, "unattested_appends": 0, "detail": {}}
        if payload.get("audit_heads") or table.store.names(A.FOLDER):
            chain, since = A.verify(table), A.since(table, payload.get("audit_heads") or {})
        report["audit"] = {"consistent": chain["ok"], **since}
        changed = len(report["modified"]) + len(report["missing"]) + len(report["added"])
        if changed or root != payload.get("entries_root"):
            n = len(report["modified"])
            return report | {"reason": f"tampering detected: {n} modified {'entry' if n == 1 else 'entries'}, {len(report['missing'])} missing, {len(report['added'])} added"}
        if not chain["ok"] or not since["append_only"]:
            return report | {"reason": "tampering detected: audit log rewritten"}
        if since["unattested_appends"] and not allow_unattested_appends:
            return report | {"reason": f"unattested appends: {since['unattested_appends']} audit events after signing"}
        return report | {"valid": True, "reason": "ok"}
    except Exception as e:
        return report | {"reason": f"table unreadable: {type(e).__name__}"}
