import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, size string, target string, component string, rank string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows that operators must stand: nulls, empty, blank, very long, repeated, ties; extra columns with clashing names."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    texts = [
        (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y zz"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y zz"),
        (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, words), (8, words), (None, "a b c d e f g h i j k l m n o p"), (9, "Line one here.\nLine two here.\nLine one here."), (10, "éà  ñ x\x0by"),
    ]
    rows = [(d, t, None if d == 6 else "en", None if d in (1, 7) else "s", None, "x", "y", "z", "t", "c", "r") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
