import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, chunk string, kept string, score string, fp string, __chunk string, held_out string"
LONG = " ".join(f"w{k % 977} x{k % 1009}" for k in range(40_000))


def documents(spark, rows):
    """A documents table with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["z"] * 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows."""
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, LONG), (6, "one"), (7, "one"), (7, "one"), (None, "no id here"), (None, None), (8, "naïve ÉCOLE ß 日本 😀 don't"), (9, "a b c d e f g h i j k l m n o p q")]
    return documents(spark, rows), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
