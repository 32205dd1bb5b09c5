import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int, key string, base double, stratum int, score string, _lead long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    long = " ".join(f"w{i * i % 1009}" for i in range(30_000))
    texts = {1: "Plain words of a short document. It has two lines.\nThe second line.", 2: "", 3: None, 4: long, 5: "one", 6: " \t\n ", 7: "é ü ß 漢字 😀 " * 20}
    rows = [(i, t, "en", "s", 3, "k", 1, "x", 0.5, 2, "y", 4) for i, t in texts.items()]
    rows += [rows[0], rows[0], rows[1], (None,) * 12, (8, texts[1], None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
