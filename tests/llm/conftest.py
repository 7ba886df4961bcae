import pytest

from made import prose


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and extra columns whose names clash."""
    text = prose(1, 80)
    rows = [
        (1, text), (2, text), (2, text), (3, None), (4, ""), (5, " \n\t "), (6, "x" * 200_000), (7, prose(2, 30_000)),
        (None, prose(3, 60)), (None, None), (8, "one"), (9, "Äé 漢字 🙂\n\n  don't  1234"), (10, prose(4, 60)), (10, prose(5, 60)),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, ids string, score string, _1 string, word string"
    data = [(i, t, None if i == 3 else "en", None if i == 4 else f"src{(i or 0) % 3}", len(t) if t else None, "clash", "c", None, "d", "w") for i, t in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
