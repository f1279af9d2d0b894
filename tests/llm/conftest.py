import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the operators' names."""
    r = random.Random(5)
    long_text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(30_000))
    rows = [(1, "one two three.", "en"), (1, "one two three.", "en"), (2, None, None), (None, "", "en"),
            (None, None, None), (3, long_text, "xx"), (4, long_text, "xx"), (5, "\n\n \t\n", "de"), (6, "x" * 50_000, None),
            (7, "日本語 текст 🙂 \u0000 end", "ja")]
    schema = ("doc_id long, text string, lang string, key string, row string, tid string, class string, part string,"
              " rank string, words string, `group` string, _m string, _key string, places string, lines string, n string")
    return spark.createDataFrame([(*x, *["clash"] * 13) for x in rows], schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
