import pytest

LONG = "lorem ipsum dolor " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "a b c d e f", "x"), (2, "a b c d e f", None), (2, "a b c d e f", None), (3, None, "y"), (4, "", "y"),
        (5, LONG, "z"), (None, "a b c", None), (6, " \t\n ", "q"), (7, "Ünï cödé ﬁ ①\u3000x", "q"), (8, "\\ \x00 \u2581 a", "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for name in ("word", "n", "rank", "length", "component_id", "score", "part", "_text", "classes"):
        df = df.withColumn(name, df["fp"])
    return df


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
