import pytest

#: Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those used inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, pos int, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    long = "word " * 30_000 + "x" * 40_000
    line = "This line is shared by many documents."
    prose = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "a", 1, "b"), (3, long, "en", "s", len(long), "a", 1, "b"),
        (4, f"{line}\n{prose}", "en", None, 1, None, None, None), (5, f"{prose}\n  {line.upper()} ", "en", "s", 1, None, None, None),
        (6, f"{prose} tail\n{line}", "en", "s", 1, None, None, None), (7, prose, "en", "s", 1, None, None, None), (7, prose, "en", "s", 1, None, None, None),
        (None, prose, "en", "s", 1, None, None, None), (8, " \t\n\x0b ", "en", "s", 1, None, None, None), (9, "a\r\nb", "en", "s", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id < 0")
