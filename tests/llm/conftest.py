import pytest

#: Cases that every operator over documents meets: nulls in any column, empty and long texts, ties and repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again today"),
    (2, "the quick brown fox jumps over the lazy dog again and again today"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, "a text without an id that is long enough to matter here"),
    (None, None),
    (6, "word"),
    (7, "one two"),
    (7, "one two"),
    (8, "é ß 日本語 \U0001f600 mixed   blanks\r\nand lines"),
    (9, "long " * 20_000 + "tail"),
    (10, "x" * 50_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash with those the operators use inside."""
    rows = [(i, t, "x", None, 1.5, "k", 0, None, "r") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n string, label double, key string, node int, sketch string, h string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
