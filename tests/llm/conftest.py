import pytest

#: Rows that every operator must take: nulls in any column, empty and very long texts, ties and repeated rows.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "a b  c d e"), (None, "one"), (None, None), (6, "ÄÖ ß é " * 4000), (7, "x" * 70_000), (8, "1" * 5000 + "@" * 3000), (9, "tail space "), (10, "a b   c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names the operators use themselves."""
    def make(rows=ODD_TEXTS):
        extra = "chunk string, score double, fp int, rank int, length int, salt int, shard int, label int, gone_id int, id int, spans string"
        return spark.createDataFrame([(i, t, None, None, 2, "c", 0.5, 1, 1, 1, 1, 1, 1, 1, 1, "s") for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(4)

    make.rows = ODD_TEXTS
    return make
