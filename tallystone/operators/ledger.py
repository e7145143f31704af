"""A transparency log of seals: an append-only Parquet table, chained by hash and signed by its issuer."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ed25519
from ..sources.store import Store
from . import integrity as K

ZERO = "0" * 64
SEALS = "seal_id string, n long, ts string, entries_root string, payload string, issuer_sig string, prev_hash string, chain_hash string, key_id string"
KEYS = "key_id string, key_hash string, tier string, label string, licence string, created string, revoked boolean"
#: Seals a month.
TIERS = {"free": 10, "pro": 500, "business": 5000}
#: Time between two free keys of one client.
FREE_EVERY = dt.timedelta(hours=1)


def links(seals: DataFrame) -> DataFrame:
    """Seals with ``linked``: its hash follows from its predecessor's, found by an equi-join on n - 1 (no global order)."""
    before = seals.select((F.col("n") + 1).alias("n"), F.col("chain_hash").alias("before"))
    # hashed before the join, so that payloads nobody asks for aren't shuffled
    hashed = seals.withColumn("__own", F.sha2(F.concat("prev_hash", F.sha2("payload", 256)), 256))
    fits = (F.coalesce("before", F.when(F.col("n") == 1, F.lit(ZERO))) == F.col("prev_hash")) & (F.col("__own") == F.col("chain_hash"))
    return hashed.join(before, "n", "left").withColumn("linked", F.coalesce(fits, F.lit(False))).drop("__own")


def page(seals: DataFrame, after: int = 0, limit: int = 50) -> DataFrame:
    """Seals after n, in order; the limit is held between 1 and 100."""
    return seals.where(F.col("n") > after).orderBy("n").limit(min(100, max(1, limit)))


def quota(seals: DataFrame, keys: DataFrame) -> DataFrame:
    """(key_id, month, used, allowed) of each key and month with seals."""
    tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    used = seals.groupBy("key_id", F.substring("ts", 1, 7).alias("month")).agg(F.count("*").alias("used"))
    return used.join(keys.select("key_id", "tier"), "key_id", "left").select("key_id", "month", "used", F.coalesce(F.try_element_at(tier, F.col("tier")), F.lit(0)).alias("allowed"))


def issuer_key(spark: SparkSession, path: str, passphrase: str) -> ed25519.KeyPair:
    """The issuer's pair from an encrypted key file, which is made where there is none; plain files are refused."""
    if not passphrase:
        raise ValueError("an issuer's key needs a passphrase")
    if not os.path.exists(path):
        ed25519.save_private(ed25519.generate_keypair(spark), path, spark, passphrase)
    elif not ed25519.is_encrypted(path):
        raise ValueError(f"{path} is not encrypted")
    return ed25519.load_private(path, spark, passphrase)


def by_roots(seals: DataFrame, roots: DataFrame) -> DataFrame:
    """Seals whose root is among ``roots`` (entries_root)."""
    return seals.join(roots.select("entries_root").distinct(), "entries_root", "left_semi").select(*seals.columns)


class Ledger:
    """One log in a folder; appends are made one at a time under a lock. ``issuer`` signs every seal."""

    def __init__(self, spark: SparkSession, path: str, issuer: ed25519.KeyPair, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self.spark, self.path, self.issuer, self.clock = spark, path.rstrip("/"), issuer, clock
        self.store = Store(spark, path)

    def now(self) -> str:
        return self.clock().astimezone(dt.UTC).isoformat().replace("+00:00", "Z")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self.store.names(name) else self.spark.createDataFrame([], schema)

    def seals(self) -> DataFrame:
        return self._table("seals", SEALS)

    def _add(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    # ---- keys

    def keys(self) -> DataFrame:
        """The newest state of each key."""
        rows = self._table("keys", KEYS)
        return rows.groupBy("key_id").agg(*[(F.max(c) if c == "revoked" else F.min(c)).alias(c) for c in rows.columns if c != "key_id"])

    def create_key(self, tier: str = "free", label: str = "", licence: str | None = None) -> str:
        """A new API key; only its hash is stored."""
        if tier not in TIERS:
            raise ValueError(f"unknown tier: {tier}")
        secret = uuid.uuid4().hex + uuid.uuid4().hex
        self._add("keys", KEYS, (uuid.uuid4().hex, hashlib.sha256(secret.encode()).hexdigest(), tier, label, licence, self.now(), False))
        return secret

    def resolve_key(self, secret: str) -> dict[str, Any] | None:
        row = self.keys().where((F.col("key_hash") == hashlib.sha256(secret.encode()).hexdigest()) & ~F.col("revoked")).first()
        return row.asDict() if row else None

    def free_key(self, client: str) -> str:
        """A free key for a client (an address, say), one an hour; PermissionError before the hour is over."""
        label = f"client:{client}"
        with self.store.lock(".keys.lock"):
            last = self.keys().where((F.col("tier") == "free") & (F.col("label") == label)).agg(F.max("created")).first()[0]
            if last and self.clock() - dt.datetime.fromisoformat(last.replace("Z", "+00:00")) < FREE_EVERY:
                raise PermissionError("one free key an hour for each client")
            return self.create_key("free", label)

    def revoke(self, licence: str) -> int:
        """Revoke all keys of a licence; how many."""
        rows = self.keys().where((F.col("licence") == licence) & ~F.col("revoked")).collect()
        for r in rows:
            self._add("keys", KEYS, (r.key_id, r.key_hash, r.tier, r.label, r.licence, r.created, True))
        return len(rows)

    def usage(self, secret: str) -> dict[str, Any]:
        key = self.resolve_key(secret)
        if not key:
            raise PermissionError("unknown or revoked key")
        used = self.seals().where((F.col("key_id") == key["key_id"]) & (F.substring("ts", 1, 7) == self.now()[:7])).count()
        return {"tier": key["tier"], "used": used, "limit": TIERS[key["tier"]], "remaining": TIERS[key["tier"]] - used}

    # ---- seals

    def seal(self, entries_root: str, entry_count: int, subject: dict[str, Any], api_key: str, signature_doc: dict | None = None) -> dict[str, Any]:
        """Append a seal and return its receipt. With a signature document the subject's key is proven, else only claimed."""
        if not re.fullmatch(r"[0-9a-f]{64}", entries_root or ""):
            raise ValueError("entries_root must be 64 hexadecimal digits")
        verified = False
        if signature_doc is not None:
            payload = signature_doc.get("payload") or {}
            if payload.get("public_key") != subject.get("public_key") or payload.get("entries_root") != entries_root:
                raise ValueError("proof of possession is for another key or root")
            if not ed25519.verify(payload["public_key"], K.canonical(payload), signature_doc.get("signature", "")):
                raise ValueError("proof of possession: bad signature")
            verified = True
        with self.store.lock(".lock"):
            state = self.usage(api_key)
            if state["remaining"] <= 0:
                raise PermissionError("quota exhausted")
            key = self.resolve_key(api_key)
            head = self.seals().orderBy(F.desc("n")).first()
            n, prev = (head.n + 1, head.chain_hash) if head else (1, ZERO)
            body = {
                "v": 1, "seal_id": uuid.uuid4().hex, "n": n, "ts": self.now(), "entries_root": entries_root, "entry_count": entry_count,
                "subject": {"signer": subject.get("signer"), "public_key": subject.get("public_key"), "name": subject.get("name"), "verified": verified},
                "tier": key["tier"], "prev_hash": prev, "issuer_public_key": self.issuer.public_hex,
            }
            text = K.canonical(body)
            sig = ed25519.sign(self.spark, self.issuer.private_hex, text)
            chain = hashlib.sha256((prev + hashlib.sha256(text).hexdigest()).encode()).hexdigest()
            self._add("seals", SEALS, (body["seal_id"], n, body["ts"], entries_root, text.decode(), sig, prev, chain, key["key_id"]))
        return {"seal_id": body["seal_id"], "n": n, "payload": body, "issuer_sig": sig, "chain_hash": chain, "issuer_public_key": self.issuer.public_hex, "rfc3161": None, "quota": {"used": state["used"] + 1, "limit": state["limit"]}}

    def get(self, seal_id: str) -> dict[str, Any] | None:
        row = self.seals().where(F.col("seal_id") == seal_id).first()
        return row.asDict() if row else None

    def find_by_root(self, entries_root: str) -> DataFrame:
        return by_roots(self.seals(), self.spark.createDataFrame([(entries_root.lower(),)], "entries_root string")).orderBy("n")

    def health(self) -> dict[str, Any]:
        """Whether the log can be read, and whose it is."""
        self.store.names("seals")
        return {"ok": True, "issuer_public_key": self.issuer.public_hex}

    def entries(self, after: int = 0, limit: int = 50) -> DataFrame:
        """A page of the public log: what was sealed when, with its chain hash and the subject's name."""
        name = F.coalesce(F.get_json_object("payload", "$.subject.name"), F.lit(""))
        return page(self.seals(), after, limit).select("n", "seal_id", "ts", "entries_root", "chain_hash", name.alias("name"))

    def log_list(self, after: int = 0, limit: int = 50) -> DataFrame:
        return page(self.seals(), after, limit)

    def verify_seal(self, seal_id: str) -> dict[str, Any]:
        """Whether one seal is by this issuer, signed, and linked to its predecessor."""
        row = links(self.seals()).where(F.col("seal_id") == seal_id).first()
        if not row:
            return {"valid": False, "reason": "unknown seal"}
        import json

        body = json.loads(row.payload)
        checks = {"issuer": body.get("issuer_public_key") == self.issuer.public_hex, "signature": ed25519.verify(self.issuer.public_hex, row.payload.encode(), row.issuer_sig), "chain": row.linked, "tsa": "absent"}
        good = checks["issuer"] and checks["signature"] and checks["chain"]
        return {"valid": good, "reason": "ok" if good else "seal does not verify", "n": row.n, "payload": body, **checks}

    def audit(self) -> dict[str, Any]:
        """Every link and every issuer signature, checked where the rows are; the first bad n of each."""
        issuer = self.issuer.public_hex

        def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, text, sig = (b.column(i).to_pylist() for i in range(3))
                bad = [i for i, t, s in zip(n, text, sig, strict=True) if not ed25519.verify(issuer, t.encode(), s)]
                yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["n"])

        seals = self.seals()
        row = links(seals).agg(F.count("*").alias("size"), F.max_by("chain_hash", "n").alias("head"), F.min(F.when(~F.col("linked"), F.col("n"))).alias("bad"), F.max("n").alias("last")).first()
        bad_sig = seals.select("n", "payload", "issuer_sig").mapInArrow(signatures, "n long").agg(F.min("n")).first()[0]
        good = row.bad is None and bad_sig is None and (row.last or 0) == row.size
        return {"ok": good, "first_bad_n": row.bad, "first_bad_signature_n": bad_sig, "size": row.size, "head": row.head or ZERO}

    def checkpoint(self) -> dict[str, Any]:
        """A signed statement of the log's size and head."""
        row = self.seals().agg(F.count("*").alias("size"), F.max_by("chain_hash", "n").alias("head")).first()
        body = {"v": 1, "size": row.size, "head": row.head or ZERO, "ts": self.now(), "issuer_public_key": self.issuer.public_hex}
        return {"payload": body, "signature": ed25519.sign(self.spark, self.issuer.private_hex, K.canonical(body))}


RECEIPT = "meta/receipt.json"


def seal_table(table, ledger: Ledger, api_key: str) -> dict[str, Any]:
    """Have a signed table's root sealed, with its signature as proof; the receipt is kept beside the table."""
    doc = table.store.read_json(K.SIGNATURE)
    if not doc:
        raise ValueError("sign the table first")
    p = doc["payload"]
    receipt = ledger.seal(p["entries_root"], p["entry_count"], {"signer": p["signer"], "public_key": p["public_key"], "name": table.path.rsplit("/", 1)[-1]}, api_key, doc)
    table.store.write_json(RECEIPT, receipt)
    return receipt


def check_seal(table, trusted_issuers: list[str], ledger: Ledger | None = None, public_hex: str | None = None, allow_unattested_appends: bool = False) -> dict[str, Any]:
    """Five bindings: the table verifies, its root is the sealed one, a trusted issuer signed, the signer is bound, the log doesn't contradict."""
    receipt = table.store.read_json(RECEIPT)
    if not receipt:
        return {"valid": False, "reason": "no receipt"}
    report = K.verify_table(table, public_hex, allow_unattested_appends)
    if not report["valid"]:
        return {"valid": False, "reason": f"table does not verify: {report['reason']}"}
    body, doc = receipt.get("payload") or {}, table.store.read_json(K.SIGNATURE)["payload"]
    if body.get("entries_root") != doc["entries_root"]:
        return {"valid": False, "reason": "another content was sealed"}
    if body.get("issuer_public_key") not in trusted_issuers or not ed25519.verify(body["issuer_public_key"], K.canonical(body), receipt.get("issuer_sig", "")):
        return {"valid": False, "reason": "no trusted issuer signed this seal"}
    if body["subject"].get("public_key") != doc["public_key"]:
        return {"valid": False, "reason": "the seal is for another signer"}
    if ledger is not None:
        state = ledger.verify_seal(receipt["seal_id"])
        if not state["valid"] or state["payload"] != body:
            return {"valid": False, "reason": f"the log contradicts the receipt: {state['reason']}", "registry": "contradicts"}
    return {"valid": True, "reason": "ok", "registry": "confirmed" if ledger else "unreachable", "n": receipt["n"]}
