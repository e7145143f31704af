import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i * seed) % len(WORDS)] + str((seed + i) % 13) for i in range(n))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, one id twice, and columns with clashing names."""
    near = sentence(3, 120)
    rows = [
        (1, near), (2, near.upper()), (3, near + " and more"), (4, None), (5, ""), (6, " \t\n"), (None, sentence(5, 40)), (None, None), (7, sentence(7, 40000)), (8, "é日本語 x́ <|endoftext|>"),
        (9, "one two"), (10, "one two"), (11, "short"), (12, sentence(9, 30)), (12, sentence(9, 30)), (12, sentence(11, 30)), (13, "x" * 30000), (14, "12 34 !!"), (15, near.replace("alpha", "omega", 1)),
    ]
    df = spark.createDataFrame([(i, t, None if k % 4 == 0 else "en" if k % 2 else "fr", None if k % 3 == 0 else "s", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("id", "part", "score", "rank", "rep", "label", "salt", "length", "digest", "ids", "predicted", "lang_pred", "sequence_id", "offset", "component_id", "n", "key", "host", "norm")
    return df.withColumns({c: F.lit(-1) for c in names})


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
