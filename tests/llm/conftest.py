import pytest

ODD = [
    (1, "A plain text of some words, twice.", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n ", "fr"),
    (5, "A plain text of some words, twice.", "en"),
    (None, "A plain text of some words, twice.", "en"),
    (6, "word " * 30_000, "de"),
    (7, "12345 !!! *** ???", None),
    (8, "é ü ▁ 日本 \U0001F44D́ \0 \x85 x", "es"),
    (8, "é ü ▁ 日本 \U0001F44D́ \0 \x85 x", "es"),
]
SCHEMA = "doc_id long, text string, lang string, kept boolean, row string, score double, fp long, component_id long, __id long, __run long, id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(*r, None, "r", 0.5, 1, 2, 3, 4, "z") for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
