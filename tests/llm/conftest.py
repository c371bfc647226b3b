import pytest

#: Nulls in each column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside.
ROWS = [
    (1, "Plain words, and 12 numbers.\n\nIt's fine.", "en"),
    (1, "Plain words, and 12 numbers.\n\nIt's fine.", "en"),
    (2, "", "en"),
    (3, None, None),
    (None, "no id here", "de"),
    (None, None, None),
    (4, "word " * 30_000, "en"),
    (5, "x" * 40_000, "en"),
    (6, "Ünïcödé ğüş 漢字かな\u2003“quoted”\x1c\x85 e\u0301 \U0001f600\U0001f468\u200d\U0001f469 ΑΣ", "fr"),
    (7, "<|endoftext|> and <|startoftext|>x  \t\r\n  tail   ", "es"),
    (8, "new \U00011de0 \u0558 letters", "es"),
    (9, " ", ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    """doc_id, text, and clashing extra columns."""
    rows = [(i, t, l, "s", 7, "b", 1, "p", 0.5) for i, t, l in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string, id long, base string, n_tokens double")
