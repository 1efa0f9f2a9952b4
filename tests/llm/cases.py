"""Hard rows for every operator: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"word{i % 977} {i}" for i in range(20_000))
ROWS = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Ünïcode ß 日本語 text"), (6, LONG), (7, "the same text twice"), (8, "the same text twice"), (8, "the same text twice"), (None, "a text without an id"), (9, "\n\n***\n---")]


def hard_documents(spark):
    """Rows with columns whose names operators use themselves."""
    rows = [(i, t, "en", "src", 0, 1, 2, 3, 4) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, n long, k long, score long")


def empty_documents(spark):
    return hard_documents(spark).limit(0)
