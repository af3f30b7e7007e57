import pytest

LONG = "ab" * 60_000
WORDS = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows, ties and columns with names used inside."""
    rows = [
        (None, "a line without an id that is long enough", 1, "x"),
        (1, None, 1, "x"),
        (2, "", 1, None),
        (3, " \t\n\n ", None, "x"),
        (4, LONG, 1, "x"),
        (5, WORDS, 1, "x"),
        (5, WORDS, 1, "x"),
        (6, WORDS, 2, "y"),
        (7, f"start here {PASSAGE} and an end", 2, "y"),
        (8, f"other words first {PASSAGE}", 2, "y"),
        (9, "one two", 2, "y"),
        (10, "One TWO", 2, "y"),
        (11, "card 4012888888881881 mail a@b.example.com tel +1 (302) 555-1768 ip 10.0.0.1", 3, "z"),
        (12, "☃ ▁ ́ ünï ß", 3, "z"),
    ]
    return spark.createDataFrame([(*r, "en", 1, 2, 3, "k") for r in rows], "doc_id long, text string, i int, e string, lang string, key int, seed int, n int, line_kept string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
