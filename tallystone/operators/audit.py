"""The append-only audit log: hash-chained JSON lines, written one at a time, verified in parallel."""

from __future__ import annotations

import getpass
import hashlib
import json
import re
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..sources.table import Table

FOLDER = "meta/audit"
ZERO = "0" * 64


def chained_line(event: dict[str, Any], before: str) -> tuple[str, dict[str, Any]]:
    """The line of an event that carries the hash of the line before and its own, which comes last."""
    event = {k: v for k, v in event.items() if k != "sha256"} | {"prev_sha256": before}
    event["sha256"] = hashlib.sha256(json.dumps(event, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return json.dumps(event, ensure_ascii=False, separators=(",", ":")), event


def append(table: Table, event: dict[str, Any], chained: bool = True, day: str | None = None) -> dict[str, Any]:
    """Add an event to the day's file. A chained one carries the hash of the line before and its own, which comes last."""
    event = {**event}
    event.setdefault("ts", table.now())
    event.setdefault("user", getpass.getuser())
    day = day if day and re.fullmatch(r"\d{8}", day) else table.clock().strftime("%Y%m%d")
    name = f"{FOLDER}/{day}.jsonl"
    with table.store.lock("meta/.audit.lock"):
        if chained:
            last = table.store.last_line(name)
            _, event = chained_line(event, hashlib.sha256(last.encode()).hexdigest() if last is not None else ZERO)
        table.store.append_line(name, json.dumps(event, ensure_ascii=False, separators=(",", ":")))
    return event


def lines(table: Table) -> DataFrame:
    """(file, line_no from 1, line) of the audit log."""
    schema = "file string, line_no int, line string"
    if not table.store.names(FOLDER):
        return table.spark.createDataFrame([], schema)
    whole = table.spark.read.text(f"{table.path}/{FOLDER}/*.jsonl", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    each = whole.select("file", F.posexplode(F.filter(F.split("value", "\n"), lambda x: x != "")).alias("at", "line"))
    return each.select("file", (F.col("at") + 1).alias("line_no"), "line")


def events(table: Table) -> DataFrame:
    """Every audit event in file and line order: parsed fields, or ``_raw`` and ``_error`` of a broken line."""
    parsed = F.try_parse_json("line")
    return lines(table).select(
        "file", "line_no", F.get_json_object("line", "$.ts").alias("ts"), F.get_json_object("line", "$.op").alias("op"), F.get_json_object("line", "$.user").alias("user"),
        "line", F.when(parsed.isNull(), F.col("line")).alias("_raw"), F.when(parsed.isNull(), F.lit("invalid JSON")).alias("_error"),
    ).orderBy("file", "line_no")


def links(chain: DataFrame, by: str = "file", at: str = "line_no", line: str = "line") -> DataFrame:
    """Each line with the hash of the one before it in its file: (by, at, line, line_hash, before)."""
    w = Window.partitionBy(by).orderBy(at)
    hashed = chain.select(by, at, line, F.sha2(F.col(line), 256).alias("line_hash"))
    return hashed.withColumn("before", F.coalesce(F.lag("line_hash").over(w), F.lit(ZERO)))


def checked(chain: DataFrame) -> DataFrame:
    """Lines with ``signed`` (carries hashes) and ``good`` (link and own hash hold; unsigned lines only advance the chain)."""
    own = F.get_json_object("line", "$.sha256")
    prev = F.get_json_object("line", "$.prev_sha256")
    body = F.regexp_replace("line", r',"sha256":"[0-9a-f]{64}"\}$', "}")
    signed = F.coalesce(own.isNotNull() & prev.isNotNull(), F.lit(False))
    good = ~signed | ((prev == F.col("before")) & (F.sha2(body, 256) == own))
    return links(chain).withColumns({"signed": signed, "good": F.coalesce(good, F.lit(False))})


def first_bad(chain: DataFrame) -> DataFrame:
    """Per file: lines, signed lines, the first bad line (null if none), the head hash."""
    return checked(chain).groupBy("file").agg(
        F.count("*").alias("lines"), F.sum(F.col("signed").cast("int")).alias("signed"), F.min(F.when(~F.col("good"), F.col("line_no"))).alias("first_bad_line"), F.max_by("line_hash", "line_no").alias("head")
    )


def verify(table: Table) -> dict[str, Any]:
    """Whether every file's chain holds, with the first bad line of each that doesn't."""
    rows = sorted(first_bad(lines(table)).collect(), key=lambda r: r.file) if table.store.names(FOLDER) else []  # a row a day
    bad = {r.file: r.first_bad_line for r in rows if r.first_bad_line is not None}
    return {"ok": not bad, "consistent": not bad, "files": len(rows), "events": sum(r.lines for r in rows), "signed": sum(r.signed or 0 for r in rows), "bad": bad}


def heads(table: Table) -> dict[str, str]:
    """The last line's hash of each file; ``!inconsistent`` where the chain is broken."""
    return {r.file: "!inconsistent" if r.first_bad_line is not None else r.head for r in first_bad(lines(table)).collect()}


def progress(chain: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file, lines, head, anchor): of each file of the log or of ``anchors`` (file, head), its lines, the head it once had, and that line's number now."""
    linked = links(chain)
    at = linked.join(anchors, "file").where(F.col("line_hash") == F.col("head")).groupBy("file").agg(F.max("line_no").alias("anchor"))
    return linked.groupBy("file").agg(F.count("*").alias("lines")).join(anchors, "file", "full_outer").join(at, "file", "left")


def since(table: Table, signed: dict[str, str]) -> dict[str, Any]:
    """What happened to the log since its heads were signed: rewritten, missing, or appended to."""
    state = progress(lines(table), table.spark.createDataFrame(list(signed.items()), "file string, head string")).collect()  # a row a day
    out: dict[str, Any] = {"append_only": True, "unattested_appends": 0, "detail": {}}
    for r in state:
        if r.lines is None:
            if r.head == ZERO:
                continue
            status = "missing"
        elif r.head is None:
            status, out["unattested_appends"] = "new", out["unattested_appends"] + r.lines
        elif r.head == ZERO:
            status, out["unattested_appends"] = "appended", out["unattested_appends"] + r.lines
        elif r.anchor is None:
            status = "history_rewritten"
        else:
            after = r.lines - r.anchor
            status, out["unattested_appends"] = ("appended" if after else "same"), out["unattested_appends"] + after
        out["detail"][r.file] = status
        if status in ("missing", "history_rewritten"):
            out["append_only"] = False
    return out
