"""Zip containers as users have them, built here with zipfile and pyarrow alone."""

import datetime as dt
import hashlib
import io
import json
import os
import zipfile

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallystone.functions import ed25519
from tallystone.operators import audit, integrity
from tallystone.operators.encrypt import CorruptCiphertext, WrongPassphrase, derive_key
from tallystone.sources import container as C


def parquet(frame) -> bytes:
    buffer = io.BytesIO()
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), buffer, compression="zstd")
    return buffer.getvalue()


def frame(country: str, n: int, start: int = 0):
    rows = range(start, start + n)
    return pd.DataFrame({"id": list(rows), "country": country, "dni": [f"D{i:05}" for i in rows], "salario": [1000.0 + i for i in rows], "ts": pd.to_datetime([f"2024-01-{1 + i % 28:02}" for i in rows], utc=True), "nota": [None if i % 3 else "x" for i in rows]})


PARTS = {"AR": frame("AR", 50), "UY": frame("UY", 50, 50)}


def entries(parts=PARTS):
    out = {"manifest.json": json.dumps({"version": 1, "name": "mkdf"}).encode()}
    index = []
    for i, (k, f) in enumerate(parts.items()):
        name = f"chunks/country={k}/part-{i:06}.parquet"
        out[name] = parquet(f)
        index.append({"chunk_id": f"{i:06}", "path": name, "min": float(f["id"].min()), "max": float(f["id"].max())})
    out["indexes/id.minmax.json"] = json.dumps({"version": 1, "column": "id", "index": "minmax", "entries": index}).encode()
    return out


def build(path, content=None, comment=b"") -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in (content or entries()).items():
            z.writestr(name, raw)
        z.comment = comment
    return str(path)


def same(df, want):
    got = df.toPandas()
    for c in got.columns:
        if isinstance(got[c].dtype, pd.DatetimeTZDtype) or str(got[c].dtype).startswith("datetime"):
            got[c] = pd.to_datetime(got[c]).dt.tz_localize(None)
            want = want.assign(**{c: want[c].dt.tz_localize(None)})
    key = list(got.columns)
    a, b = (x[key].astype(object).where(x[key].notna(), None).sort_values(key[0]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_reads_what_was_written(spark, tmp_path):
    path, whole = build(tmp_path / "a.zip"), pd.concat(PARTS.values())
    same(C.read_container(spark, path), whole)
    same(C.read_container(spark, path, ["id", "nota"]), whole[["id", "nota"]])
    same(C.read_container(spark, path, ["id"], "country = 'UY' AND salario >= 1090"), whole[(whole.country == "UY") & (whole.salario >= 1090)][["id"]])
    same(C.read_container(spark, path, ["id"], "ts >= '2024-01-20' AND nota IS NULL"), whole[(whole.ts >= pd.Timestamp("2024-01-20", tz="UTC")) & whole.nota.isna()][["id"]])
    assert [r.id for r in C.read_container(spark, path, ["id"], head=3).collect()] == [0, 1, 2]
    assert C.read_container(spark, path).count() == 100
    for bad in ({"columns": ["nope"]}, {"where": "nope = 1"}):
        with pytest.raises(ValueError, match="unknown column"):
            C.read_container(spark, path, **bad)


def test_chunks_are_pruned_by_the_containers_indexes(spark, tmp_path, monkeypatch):
    path = build(tmp_path / "a.zip")
    seen = []
    monkeypatch.setattr(C, "_pruned", lambda *a, f=C._pruned: seen.append(f(*a)) or seen[-1])
    assert C.read_container(spark, path, ["id"], "id < 10").count() == 10 and [n for _, n, _ in seen[-1]] == ["chunks/country=AR/part-000000.parquet"]
    assert C.read_container(spark, path, ["id"], "id < 10 OR id = 60").count() == 11 and len(seen[-1]) == 2
    content = entries()
    doc = json.loads(content["indexes/id.minmax.json"])
    content["indexes/id.minmax.json"] = json.dumps(doc | {"entries": doc["entries"][:1]}).encode()  # a chunk without an entry stays
    assert C.read_container(spark, build(tmp_path / "b.zip", content), ["id"], "id > 90").count() == 9 and len(seen[-1]) == 1


def test_chunks_of_different_types_and_large_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "HELD", 10)  # entries as streams
    odd = {"A": pd.DataFrame({"x": [1, 2], "y": [None, None]}), "B": pd.DataFrame({"x": [1.5, None], "y": ["a", "b"], "z": [1, 2]}), "C": pd.DataFrame({"x": pd.Series([], dtype="float64"), "y": pd.Series([], dtype=object)})}
    content = {f"chunks/part-{i:06}.parquet": parquet(f) for i, f in enumerate(odd.values())}
    df = C.read_container(spark, build(tmp_path / "a.zip", content))
    assert sorted(map(str, map(tuple, df.select("x", "y", "z").collect()))) == sorted(map(str, [(1.0, None, None), (2.0, None, None), (1.5, "a", 1), (None, "b", 2)]))
    buffer = io.BytesIO()
    pq.write_table(pa.table({"n": list(range(5000)), "t": [str(i) for i in range(5000)]}), buffer, row_group_size=700)
    big = C.read_container(spark, build(tmp_path / "b.zip", {"chunks/part-000000.parquet": buffer.getvalue()}), ["t", "n"], "n >= 4990")
    assert sorted((r.n, r.t) for r in big.collect()) == [(i, str(i)) for i in range(4990, 5000)]
    assert C.read_container(spark, build(tmp_path / "c.zip", {"manifest.json": b"{}"})).count() == 0


def test_snapshots(spark, tmp_path):
    content = entries()
    first = next(n for n in content if n.startswith("chunks/"))
    for ts, names in (("2024-01-01T00:00:00Z", [first]), ("2024-02-01T00:00:00Z", [n for n in content if n.startswith("chunks/")])):
        content[f"snapshots/{ts[:10]}.json"] = json.dumps({"version": 1, "ts": ts, "chunks": [{"chunk_id": "0", "path": n} for n in names], "indexes": []}).encode()
    path = build(tmp_path / "a.zip", content)
    assert C.read_container(spark, path, ["id"], as_of="2024-01-15T00:00:00Z").count() == 50 and C.read_container(spark, path, ["id"], as_of="2025-01-01").count() == 100
    for bad in ("2023-01-01", "yesterday"):
        with pytest.raises(ValueError, match="no snapshot|invalid as_of"):
            C.read_container(spark, path, as_of=bad)


def rewritten(path, change):
    raw = open(path, "rb").read()
    open(path, "wb").write(change(raw))


@pytest.mark.parametrize(
    ("name", "reason"),
    [("prefix", "before the first entry"), ("suffix", "after the end"), ("comment", "comment"), ("duplicate", "duplicate"), ("parent", "unsafe name"), ("absolute", "unsafe name"), ("bomb", "ratio"), ("large", "size limit"), ("cut", "refused"), ("text", "refused")],
)
def test_envelopes_that_are_refused(spark, tmp_path, name, reason):
    path, limits = tmp_path / "a.zip", C.Limits()
    build(path, comment=b"free text" if name == "comment" else b"")
    if name in ("duplicate", "parent", "absolute", "bomb"):
        with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
            z.writestr({"duplicate": "manifest.json", "parent": "chunks/../../x", "absolute": "/etc/x", "bomb": "data/bomb.bin"}[name], b"\0" * (8 << 20) if name == "bomb" else b"{}")
    change = {"prefix": lambda b: b"\x90" * 1700 + b, "suffix": lambda b: b + b"PK tail", "cut": lambda b: b[:-30], "text": lambda b: b"no zip at all"}
    if name in change:
        rewritten(path, change[name])
    if name == "large":
        limits = C.Limits(entry=1000)
    with pytest.raises(C.EnvelopeError, match=reason):
        C.read_container(spark, str(path), limits=limits)
    report = C.verify_container(spark, str(path), limits=limits)
    assert not report["valid"] and reason.split("|")[0] in report["reason"]


def signed(spark, path, content, key):
    digests = {n: hashlib.sha256(raw).hexdigest() for n, raw in content.items() if C.is_signed(n)}
    payload = {"v": 1, "alg": "ed25519", "entries_root": integrity.root_of(digests), "entry_count": len(digests), "entries": digests, "audit_heads": {}, "signer": "me", "signed_at": "2024-01-01T00:00:00Z", "public_key": key.public_hex}
    doc = {"payload": payload, "signature": ed25519.sign(spark, key.private_hex, integrity.canonical(payload))}
    return build(path, {**content, C.SIGNATURE: json.dumps(doc).encode()})


def test_signatures(spark, tmp_path):
    key, other = ed25519.generate_keypair(spark), ed25519.generate_keypair(spark)
    line, event = audit.chained_line({"ts": "2024-01-01", "op": "write"}, audit.ZERO)
    line2 = audit.chained_line({"ts": "2024-01-02", "op": "read"}, hashlib.sha256(line.encode()).hexdigest())[0]
    content = entries() | {"profiles/audit/20240101.jsonl": f"{line}\n{line2}\n".encode(), "profiles/usage.json": b"{}"}
    path = signed(spark, tmp_path / "a.zip", content, key)
    r = C.verify_container(spark, path, key.public_hex)
    assert r["valid"] and r["reason"] == "ok" and r["trusted_key"] and r["signer"] == "me" and r["audit"] == {"consistent": True}
    assert not C.verify_container(spark, path, other.public_hex)["valid"]
    assert C.verify_container(spark, build(tmp_path / "b.zip"))["reason"].startswith("unsigned")
    doc = json.loads(zipfile.ZipFile(path).read(C.SIGNATURE))
    victim = next(n for n in content if n.startswith("chunks/"))
    for change, counts in (({victim: content[victim] + b"\0"}, (1, 0, 0)), ({victim: None}, (0, 1, 0)), ({"chunks/part-000009.parquet": b"x"}, (0, 0, 1)), ({"profiles/usage.json": b"[]"}, (0, 0, 0))):
        changed = {n: raw for n, raw in {**content, C.SIGNATURE: json.dumps(doc).encode(), **change}.items() if raw is not None}
        r = C.verify_container(spark, build(tmp_path / "c.zip", changed), key.public_hex)
        assert tuple(len(r[k]) for k in ("modified", "missing", "added")) == counts and r["valid"] == (not any(counts))
    forged = {**content, C.SIGNATURE: json.dumps(doc).encode(), "profiles/audit/20240101.jsonl": f"{line2}\n{line}\n".encode()}
    assert "audit" in C.verify_container(spark, build(tmp_path / "d.zip", forged))["reason"]
    for bad in (b"[]", b'{"payload":"x"}', b'{"nope":1}', b"{", json.dumps({**doc, "signature": "zz"}).encode()):
        r = C.verify_container(spark, build(tmp_path / "e.zip", {**content, C.SIGNATURE: bad}))
        assert not r["valid"] and r["reason"]
    rewritten(path, lambda b: b.replace(content[victim][200:260], b"\0" * 60) if content[victim][200:260] in b else b[:400] + bytes([b[400] ^ 1]) + b[401:])
    assert not C.verify_container(spark, path, key.public_hex)["valid"]


def sealed(spark, plain: bytes, key: bytes, aad: str) -> bytes:
    row = spark.createDataFrame([(bytearray(plain), bytearray(key), bytearray(aad.encode()))], "p binary, k binary, a binary")
    return bytes(row.select(F.call_function("aes_encrypt", "p", "k", F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), "a")).first()[0])


@pytest.mark.parametrize("version", [1, 2])
def test_encrypted_columns(spark, tmp_path, version):
    salt, cost = b"\7" * 16, {"n": 2**12, "r": 8, "p": 1}
    key = derive_key("pass phrase", salt, **cost)
    config = {"version": version, "algo": "AES-256-GCM", "kdf": "scrypt", "scrypt": cost | {"salt": salt.hex()}, "nonce_size": 12, "columns": ["dni", "nota"], "parts": {}}
    if version == 2:
        check = sealed(spark, b"surx-check", key, "sf-check:abc")
        config |= {"aad_v": 2, "container_id": "abc", "check": {"nonce": check[:12].hex(), "ct": check[12:].hex()}}
    content = entries()
    for i, (k, f) in enumerate(PARTS.items()):
        content[f"chunks/country={k}/part-{i:06}.parquet"] = parquet(f.drop(columns=["dni", "nota"]))
        for c in ("dni", "nota"):
            aad = f"part:{i:06}|col:{c}"
            content[f"enc/part-{i:06}/{c}.bin"] = sealed(spark, parquet(f[[c]]), key, f"sf:abc|{aad}" if version == 2 else aad)
    content[C.CRYPTO] = json.dumps(config).encode()
    path, whole = build(tmp_path / "a.zip", content), pd.concat(PARTS.values())
    same(C.read_container(spark, path), whole.drop(columns=["dni", "nota"]))
    same(C.read_container(spark, path, passphrase="pass phrase").select("id", "dni", "nota", "country"), whole[["id", "dni", "nota", "country"]])
    same(C.read_container(spark, path, ["id"], "dni = 'D00007' OR nota = 'x'", passphrase="pass phrase"), whole[(whole.dni == "D00007") | (whole.nota == "x")][["id"]])
    for asked in ({"columns": ["dni"]}, {"columns": ["id"], "where": "dni = 'D00007'"}):
        with pytest.raises(ValueError, match="need a passphrase"):
            C.read_container(spark, path, **asked)
    if version == 2:
        with pytest.raises(WrongPassphrase):
            C.read_container(spark, path, passphrase="other")
    moved = content | {"enc/part-000000/dni.bin": content["enc/part-000001/dni.bin"]}
    with pytest.raises(Exception, match=CorruptCiphertext.__name__):
        C.read_container(spark, build(tmp_path / "b.zip", moved), ["dni"], passphrase="pass phrase").collect()


def test_export_and_patterns(spark, tmp_path):
    rows = [(i, ["a", "b/../c", None][i % 3], dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i) if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, kind string, at timestamp_ntz, v double").repartition(3)
    made = C.write_containers(df, f"file://{tmp_path}/out", "kind", rows_per_chunk=100).collect()
    assert len(made) == 3 and sum(r.rows for r in made) == 1000 and all(r.chunks >= 3 for r in made) and not [n for n in os.listdir(tmp_path / "out") if n.endswith(".tmp")]
    back = C.read_container(spark, f"{tmp_path}/out/*.zip")
    assert back.exceptAll(df).count() == 0 and back.count() == 1000
    assert C.read_container(spark, f"{tmp_path}/out/*.zip", ["id"], "at >= '2024-02-01' AND kind IS NULL").count() == sum(1 for r in rows if r[2] >= dt.datetime(2024, 2, 1) and r[1] is None)
    with pytest.raises(FileNotFoundError):
        C.read_container(spark, f"{tmp_path}/none/*.zip")


def test_commands(spark, tmp_path, capsys):
    from tallystone.cli import run
    from tallystone.sources.table import Table

    key = ed25519.generate_keypair(spark)
    path, t = signed(spark, tmp_path / "a.zip", entries(), key), str(tmp_path / "t")
    ed25519.save_public(key.public_hex, str(tmp_path / "k.pub"))
    assert run(["zip-verify", path, "--pubkey", str(tmp_path / "k.pub")], spark) == 0
    assert run(["zip-read", path, "--columns", "id", "--where", "id = 7"], spark) == 0 and '{"id":7}' in capsys.readouterr().out
    assert run(["zip-import", t, path, "--partition-by", "country"], spark) == 0 and Table(spark, t).read(where="country = 'UY'").count() == 50
    rewritten(path, lambda b: b + b"tail")
    assert run(["zip-verify", path], spark) == 1 and run(["zip-read", path], spark) == 1
    for i in range(3):
        Table(spark, t).read(["id"], f"id = {i}", usage=True)
    assert run(["kpis", t, "--window", "2"], spark) == 0 and '"reads_total": 2' in capsys.readouterr().out
