import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} and then {i * i % 1013}." for i in range(6000))


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, "one two three four five six", "en", "a"), (2, "one two three four five six", "en", "b"), (3, None, None, None), (4, "", "en", None),
        (5, "  \n\t ", None, "a"), (6, LONG, "de", "b"), (7, LONG + " end", "de", "c"), (8, "Straße é ü ﬁ \u0085x \U0001f600 ok ok ok", "de", "c"),
        (9, "x", "en", "a"), (9, "x", "en", "a"), (None, "no id here", "en", "a"), (None, None, None, None), (10, "<|endoftext|> a b", "en", "a"), (-5, "minus five", "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Those rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = "shard slot size taken score kept piece start length sequence_id offset g z0 digest registers component_id row_key key code h part bucket n_words base_failed copies rank".split()
    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.withColumns({n: F.lit(f"extra {n}") for n in names}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    import os

    path = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
