from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog while many people walk along the river bank and talk about the weather "
    rows = [(1, None), (2, ""), (3, " \n "), (4, prose), (5, prose), (5, prose), (6, prose + "today"), (7, "word"), (8, "é ü <|endoftext|> don't, 3.5% x.!! y"), (9, prose * 400), (10, "a,,b  c\n\nd\t"), (None, prose)]
    df = spark.createDataFrame([(i, t, "en" if t and len(t) > 20 else None, "s", len(t or "")) for i, t in rows], DOCS)
    return df.selectExpr("*", "1 as chunk", "'x' as fp", "2 as key", "3 as shard", "4 as total", "5 as `bit`")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
