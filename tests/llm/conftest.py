import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, shard int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with results."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon.", "en"), (2, "The cat sat on the mat and looked at the moon.", "en"), (3, None, None), (4, "", "en"), (5, "   \n\t ", None),
        (6, "word " * 30_000, "en"), (7, "Der Hund läuft über die Straße und bellt laut.", "de"), (7, "Der Hund läuft über die Straße und bellt laut.", "de"), (8, "12345 !!! ???", None), (9, "日本語 😀 ñ", None),
    ]
    return spark.createDataFrame([(i, t, g, None, None, "x", 9.0, 99) for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
