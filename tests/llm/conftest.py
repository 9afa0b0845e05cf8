import pytest

LONG = " ".join(f"word{i % 997} of{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, "The cat sat on the mat.\nIt was happy there.\nThen it left.\nThe end.", "en", "a", 1, 7, "x"),
        (2, "The cat sat on the mat.\nIt was happy there.\nThen it left.\nThe end.", "en", "a", 1, 7, "x"),
        (2, "The cat sat on the mat.\nIt was happy there.\nThen it left.\nThe end.", "en", "a", 1, 7, "x"),
        (3, "", "en", "a", 0, 0, None), (4, None, None, None, None, None, None), (5, "123 456 !!", None, "b", 9, 1, "y"),
        (None, "Eine Katze saß auf der Matte und schlief.", "de", "b", 3, 1, "z"), (None, None, "de", None, 1, 1, ""),
        (6, LONG, "en", "c", 5, 5, "q"), (7, "a\n\n\nb\r\nc", "en", "c", 5, 5, "q"), (8, " \n \n", "en", "a", 2, 2, "r"),
        (9, "x", None, "a", 2, 2, "r"), (9, "y", "en", "b", 2, 2, "r"), (10, "日本語のテキスト 🙂 é", "ja", "a", 1, 1, "w"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, total long, score long, `ids` string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
