"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitEncoder, text_chunks

_codecs: dict[tuple[str, str], tuple[UnitEncoder, list[bytes]]] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers, a pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def codec(path: str, pattern: str) -> tuple[UnitEncoder, list[bytes]]:
    """The worker's encoder and its table of token bytes. Texts are split at safe boundaries first, so very long ones cost no more."""
    key = (path, pattern)
    if key not in _codecs:
        import tiktoken

        ranks = read_ranks(path)
        library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        lengths = np.asarray([len(t) for t in table], np.int64)
        _codecs[key] = UnitEncoder(lambda texts: [library.encode_ordinary(t) for t in texts], lengths, "<u4" if len(table) > 65536 else "<u2"), table
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = codec(path, pattern)
        for b in batches:
            ids = [x for texts in text_chunks(b.column(1)) for x in encoder(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, raw binary): the bytes the ids stand for, valid UTF-8 or not; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = codec(path, pattern)
        for b in batches:
            raw = [b"".join(map(table.__getitem__, ids or ())) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes: every text encoded, its ids decoded, both digested in one pass.

    Null and empty texts have no ids. Rows are independent, so ids may be null or repeat.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = codec(path, pattern)
        for b in batches:
            n, ids_sha, raw_sha, size = [], [], [], []
            for texts in text_chunks(b.column(1)):
                for ids in encoder(texts):
                    raw = b"".join(map(table.__getitem__, ids.tolist()))
                    n.append(len(ids)), size.append(len(raw))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    raw_sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip((n, ids_sha, raw_sha, size), schema.types[1:], strict=True)]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
