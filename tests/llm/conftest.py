import pytest

#: Awkward documents: nulls in every column, empty and blank texts, repeated rows, one id with two texts, a long text, texts that are no prose.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. It was a fine day.\nNothing else happened there.", "en", "a", 90),
    (1, "The quick brown fox jumps over the lazy dog. It was a fine day.\nNothing else happened there.", "en", "a", 90),
    (2, "The quick brown fox jumps over the lazy dog. It was a fine day.\nNothing else happened there.", "en", None, None),
    (3, "", "en", "a", 0),
    (4, None, None, "b", None),
    (None, "no id here", "en", "b", 10),
    (5, "  \n\t ", "en", "c", 5),
    (6, "émile à l'école <|endoftext|> 日本語   x", "fr", "c", 30),
    (7, "one text", "en", "c", 8),
    (7, "another text of the same id", "en", "c", 8),
    (8, " ".join(f"word{i % 911}" for i in range(30_000)), "en", "d", 1),
    (9, "a", "en", "d", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The awkward documents, with more columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit("x") for c in ("rank", "shard", "size", "fingerprint", "start", "length", "taken", "target", "digest", "ids", "unit", "row", "source_size", "text_hash", "_hash", "_id", "_cuts", "cuts", "toxic", "expected_severity", "severity_grade", "salt", "bin", "id", "hash", "key")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
