import re

import duckdb
import pytest

from tallystone.llm.queries import QUERIES, SQL


def test_one_query_an_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_columns(spark, sf):
    want = {
        "op1": "doc_id n_shingles component_id", "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op5": "doc_id held_out score predicted", "op6": "page_id url text n_chars", "op7": "doc_id start n_tokens ids_crc32", "op8": "query_id rank vec_id score", "op9": "doc_id held_out lang_pred score",
        "op10": "doc_id piece start length ids_crc32 sequence_id offset", "op11": "lang rank phrase a l r n score", "op12": "anchor_id positive_id rank negative_id positive_score negative_score", "op13": "doc_id held_out score predicted",
    }
    kinds = {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_chars": "bigint", "near_next": "double", "n_tokens": "bigint", "held_out": "boolean", "predicted": "int", "page_id": "bigint", "start": "bigint", "ids_crc32": "bigint", "rank": "int", "piece": "int", "length": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    for name, f in QUERIES.items():
        types = dict(f(spark, sf).dtypes)
        for c in want.get(name.split("_")[0], "").split():
            assert types[c] == kinds.get(c, types[c]) or name.startswith("op11_") and types[c] == "bigint", (name, c)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    got = sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    listed = ", ".join(f'"{c}"' for c in sorted(df.columns))
    assert got == sorted(map(str, con.sql(f"SELECT {listed} FROM ({SQL[name]})").fetchall()))
