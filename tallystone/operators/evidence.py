"""Evidence packs: what a table is, that it verifies, and how to check that again."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from typing import TYPE_CHECKING, Any

from . import audit as A
from . import integrity as K

if TYPE_CHECKING:
    from ..sources.table import Table

DISCLAIMER = "This pack attests integrity and traceability of the data set. It is no statement of legal conformity."
#: Bytes of a table that a pack may hold.
MOST_COPIED = 1 << 30
#: Which documents speak to which articles (fixed values).
MAPPING = [
    ("Art. 10 data governance", "EVIDENCE.json: dataset, declarations", "schema, constraints, profile, origin as declared"),
    ("Art. 11 technical documentation", "REPORT.md, signature.ed25519.json", "layout, size, signer, root digest"),
    ("Art. 12 record keeping", "audit_chain/", "hash-chained events, anchored under the signature"),
]


def audit_range(table: Table) -> dict[str, Any]:
    """First and last time and count of the audit events."""
    from pyspark.sql import functions as F

    e = A.events(table).where("ts is not null")
    row = e.agg(F.min_by("ts", F.struct("file", "line_no")).alias("first"), F.max_by("ts", F.struct("file", "line_no")).alias("last"), F.count("*").alias("events")).first()
    return row.asDict()


def build(table: Table, out: str, public_hex: str | None = None, declarations: dict[str, Any] | None = None, with_table: bool = False, archive: bool = False, most: int = MOST_COPIED) -> dict[str, Any]:
    """Write the pack to a local folder; RuntimeError for unsigned, tampered or unreadable tables.

    ``with_table`` copies the table's files into it, up to ``most`` bytes (the copy passes through the
    driver; larger tables are referred to by their digests), and ``archive`` zips the folder beside it.
    """
    report = K.verify_table(table, public_hex)
    if not report["valid"]:
        raise RuntimeError(f"no evidence for this table: {report['reason']}")
    listed = table.store.files() if with_table else []
    if sum(size for _, size in listed) > most:
        raise ValueError(f"the table is larger than the {most} bytes that a pack may hold")
    info, doc = table.inspect(), table.store.read_json(K.SIGNATURE)
    os.makedirs(os.path.join(out, "audit_chain"), exist_ok=True)
    span = audit_range(table)
    evidence = {
        "spec_version": 1, "generated_at": table.now(), "disclaimer": DISCLAIMER, "tool": "tallystone", "container": {"name": info["name"], "bytes": info["bytes_total"]},
        "signature": {k: doc["payload"][k] for k in ("signer", "signed_at", "public_key", "entries_root", "entry_count")}, "verification": report,
        "audit_chain": {**report["audit"], **span}, "dataset": {k: info[k] for k in ("schema", "rows", "n_chunks", "partitions", "quality")}, "declarations": declarations or {},
    }
    files = {
        "EVIDENCE.json": json.dumps(evidence, indent=1, ensure_ascii=False, default=str),
        "REPORT.md": f"# {info['name']}\n\nRows: {info['rows']}. Files: {info['n_chunks']}. Signed by {report['signer']} at {report['signed_at']}.\n\nRoot: `{doc['payload']['entries_root']}`\n\nAudit events: {span['events']}, {span['first']} to {span['last']}.\n\n{DISCLAIMER}\n",
        "VERIFY.md": "# How to verify\n\n1. Check `checksums.txt` against the files of this pack.\n2. Recompute each file's SHA-256, then the root: SHA-256 over sha256(name) and digest, by name.\n3. Verify the Ed25519 signature of the canonical payload with the signer's public key, obtained elsewhere.\n",
        "ai_act_mapping.md": "| Article | Where | What |\n|---|---|---|\n" + "".join(f"| {a} | {b} | {c} |\n" for a, b, c in MAPPING),
        "signature.ed25519.json": json.dumps(doc, ensure_ascii=False, indent=1),
    }
    for name in table.store.names(A.FOLDER):
        files[f"audit_chain/{name}"] = table.store.read_text(f"{A.FOLDER}/{name}")
    sums = []

    def put(name: str, raw: bytes) -> None:
        os.makedirs(os.path.dirname(os.path.join(out, name)), exist_ok=True)
        with open(os.path.join(out, name), "wb") as f:
            f.write(raw)
        sums.append(f"{hashlib.sha256(raw).hexdigest()}  {name}")

    for name, text in sorted(files.items()):
        put(name, text.encode())
    for name, _ in listed:
        put(f"table/{name}", table.store.read_bytes(name))
    with open(os.path.join(out, "checksums.txt"), "w") as f:
        f.write("\n".join(sums) + "\n")
    if archive:
        shutil.make_archive(out.rstrip("/"), "zip", out)
    return evidence
