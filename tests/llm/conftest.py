import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 97} thing{i % 31}" for i in range(30_000))


def odd_rows():
    """Nulls in each column, empty and very long texts, ties and repeated rows."""
    plain = "Then the cat sat on the mat and looked at all of the other cats in the long room."
    rows = [
        (1, plain, "en", "a", 10),
        (2, plain, "en", "a", 10),
        (2, plain, "en", "a", 10),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "de", "b", 3),
        (6, LONG, "en", "c", len(LONG)),
        (7, LONG + " end", "en", "c", 1),
        (8, "12 34 ### $$$", None, "c", 2),
        (9, "Änd süß école mañana ﬃ 日本語 áb 🙂  x", "de", None, 5),
        (10, "x" * 2000 + " " + "y1" * 700, "fr", "a", 5),
        (11, "one two", "en", "a", 5),
        (12, "ONE TWO", "en", "a", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({"fp": F.lit(1), "node": F.lit("n"), "kept": F.lit(True), "length": F.lit(7), "label": F.lit(0), "__x": F.lit(None).cast("int"), "__gone": F.lit(1), "__id": F.lit(2), "__text": F.lit("t"), "__sha": F.lit("s"), "own_id": F.lit(3), "Own_Text": F.lit("x")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
