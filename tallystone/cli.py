"""Command line: ``python -m tallystone.cli COMMAND TABLE ...``; exit 1 for a failed check or a user's error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .functions import ed25519
from .operators import audit, encrypt, evidence, integrity, ledger, optimize, profile, usage
from .sources import container
from .sources.table import Table


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallystone")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, table: bool = True):
        c = sub.add_parser(name)
        if table:
            c.add_argument("table")
        for args, options in arguments:
            c.add_argument(*args, **options)

    def flag(*names, **options):
        return names, options

    secret = flag("--passphrase", default=os.environ.get("TALLYSTONE_PASSPHRASE"))
    command("write", flag("source"), flag("--partition-by"), flag("--no-snapshot", action="store_true"))
    command("read", flag("--columns"), flag("--where"), flag("--as-of"), flag("--limit", type=int, default=10), flag("--to-csv"), secret)
    command("plan", flag("--where"), flag("--as-of"))
    command("inspect")
    command("validate")
    command("optimize", flag("--order"), flag("--target-rows", type=int, default=100_000), flag("--min-chunks", type=int, default=1), flag("--whole", action="store_true"), flag("--zorder"))
    command("reindex", flag("spec", help="JSON: {column: {minmax: {}, bloom: {}, trigrams: {}}}"))
    command("snapshot", flag("--note"))
    command("log")
    command("advise")
    command("encrypt", flag("columns"), flag("--row-key"), secret)
    command("decrypt", flag("--columns", default=""), secret)
    command("keygen", flag("--out", default="tallystone_signing"), table=False)
    command("sign", flag("--key", required=True), flag("--signer"))
    command("verify", flag("--pubkey"), flag("--allow-unattested-appends", action="store_true"))
    command("audit-verify")
    command("export", flag("out"), flag("--pubkey"))
    command("seal", flag("ledger"), flag("--issuer-key", required=True), flag("--api-key", required=True))
    command("check-seal", flag("--issuer", action="append", required=True), flag("--pubkey"))
    command("verify-seal", flag("seal_id"), flag("--issuer-key", required=True))
    command("usage")
    command("kpis", flag("--window", type=int), flag("--baseline", action="store_true"))
    reading = (flag("--columns"), flag("--where"), flag("--as-of"), secret)
    command("zip-read", flag("container"), flag("--limit", type=int, default=10), *reading, table=False)
    command("zip-verify", flag("container"), flag("--pubkey"), table=False)
    command("zip-import", flag("container"), flag("--partition-by"), *reading)
    command("demo")
    return p


def demo(spark: SparkSession, path: str) -> dict:
    """Write, sign, verify, change one value's file, and catch it."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.concat(F.lit("prompt "), "id").alias("prompt"), (F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("a"), "id", F.lit("@example.com")).alias("annotator_email"))
    t = Table(spark, path).write(rows)
    pair = ed25519.generate_keypair(spark)
    integrity.sign_table(t, pair.private_hex, "demo")
    good = integrity.verify_table(t, pair.public_hex)
    rows.limit(10).write.mode("append").parquet(f"{t.path}/data/gen-000001")
    bad = integrity.verify_table(t, pair.public_hex)
    return {"before": good["reason"], "after": bad["reason"], "added": bad["added"], "valid": good["valid"] and not bad["valid"]}


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallystone").config("spark.sql.session.timeZone", "UTC").getOrCreate()

    def show(x) -> int:
        print(json.dumps(x, indent=1, ensure_ascii=False, default=str))
        return 0

    def split(text: str | None) -> list[str] | None:
        return [c.strip() for c in text.split(",") if c.strip()] if text else None

    def key(path: str | None) -> str | None:
        return ed25519.load_public(path) if path else None

    try:
        if a.command == "keygen":
            pair = ed25519.generate_keypair(spark)
            ed25519.save_private(pair, f"{a.out}.key")
            ed25519.save_public(pair.public_hex, f"{a.out}.pub")
            return show({"private": f"{a.out}.key", "public": f"{a.out}.pub"})
        if a.command == "zip-verify":
            r = container.verify_container(spark, a.container, key(a.pubkey))
            show(r)
            return 0 if r["valid"] else 1
        if a.command.startswith("zip-"):
            df = container.read_container(spark, a.container, split(a.columns), a.where, a.as_of, passphrase=a.passphrase)
            if a.command == "zip-import":
                return show(Table(spark, a.table).write(df, partition_by=split(a.partition_by)).inspect())
            for row in df.limit(a.limit).toJSON().collect() if a.limit else df.toJSON().toLocalIterator():
                print(row)
            return 0
        if a.command == "verify-seal":
            r = ledger.Ledger(spark, a.table, ed25519.load_private(a.issuer_key)).verify_seal(a.seal_id)
            show(r)
            return 0 if r["valid"] else 1
        t = Table(spark, a.table)
        if a.command == "write":
            t.write(a.source, partition_by=split(a.partition_by), auto_snapshot=not a.no_snapshot)
            return show(t.inspect())
        if a.command == "read":
            df = t.read(split(a.columns), a.where, a.as_of, passphrase=a.passphrase)
            if a.to_csv:
                df.write.csv(a.to_csv, header=True)
                return 0
            for row in df.limit(a.limit).toJSON().collect() if a.limit else df.toJSON().toLocalIterator():
                print(row)
            return 0
        if a.command == "plan":
            return show(t.plan(a.where, a.as_of))
        if a.command == "inspect":
            return show(t.inspect())
        if a.command == "validate":
            return show(profile.validate(t))
        if a.command == "optimize":
            return show(optimize.optimize(t, target_rows=a.target_rows, order=split(a.order), min_chunks=a.min_chunks, whole=a.whole, zorder=split(a.zorder)))
        if a.command == "reindex":
            return show(optimize.reindex(t, json.loads(a.spec)))
        if a.command == "snapshot":
            return show({"snapshot": t.snapshot(a.note)})
        if a.command == "log":
            return show([r.asDict() for r in t.log().collect()])
        if a.command == "advise":
            return show(usage.advise(t))
        if a.command == "kpis":
            return show(usage.update_kpis(t, a.baseline, a.window))
        if a.command == "usage":
            return show(usage.aggregate(t))
        if a.command in ("encrypt", "decrypt"):
            if not a.passphrase:
                raise ValueError("a passphrase is needed")
            columns = split(a.columns) or []
            c = encrypt.encrypt_columns(t, columns, a.passphrase, row_key=split(a.row_key)) if a.command == "encrypt" else encrypt.decrypt_columns(t, columns, a.passphrase)
            return show({"encrypted": (c or {}).get("columns", [])})
        if a.command == "sign":
            return show({"root": integrity.sign_table(t, ed25519.load_private(a.key).private_hex, a.signer)["payload"]["entries_root"]})
        if a.command == "seal":
            return show(ledger.seal_table(t, ledger.Ledger(spark, a.ledger, ed25519.load_private(a.issuer_key)), a.api_key))
        if a.command == "export":
            evidence.build(t, a.out, key(a.pubkey))
            return show({"pack": a.out})
        r = {
            "demo": lambda: demo(spark, a.table),
            "verify": lambda: integrity.verify_table(t, key(a.pubkey), a.allow_unattested_appends),
            "audit-verify": lambda: audit.verify(t),
            "check-seal": lambda: ledger.check_seal(t, a.issuer, public_hex=key(a.pubkey)),
        }[a.command]()
        show(r)
        return 0 if r.get("valid", r.get("ok")) else 1
    except (ValueError, RuntimeError, PermissionError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
