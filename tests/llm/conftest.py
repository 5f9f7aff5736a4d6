import pytest

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 0.5, True),
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 0.5, True),
        (2, "the quick brown fox jumps over the lazy dog again and again", None, None, None, None, None),
        (3, "", "en", "a", 0, 0.0, False), (4, None, "en", "a", 0, 0.0, False), (None, None, None, None, None, None, None), (5, " \n\t ", "de", "b", 3, 0.1, False),
        (6, LONG, "en", "b", len(LONG), 0.2, False), (7, "Der schnelle braune Fuchs springt über den faulen Hund und so weiter", "de", "b", 60, 0.2, False),
        (8, "1234 5678 !!! 42", "de", "b", 16, 0.2, False), (9, "a" * 50_000, "en", "b", 50_000, 0.2, False),
        (None, "Der schnelle braune Fuchs springt über den faulen Hund und so weiter", "de", "b", 60, 0.2, False),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, held_out boolean").withColumnsRenamed({}).selectExpr("*", "'x' AS id", "'y' AS key", "'z' AS fp", "1 AS rid")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
