import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_rows(spark):
    """Every document of the small fixture as plain tuples."""
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} tail" for i in range(40_000))
    rows = [(1, "the same text of five words and more " * 8, "en", "a", 0, 0), (1, "the same text of five words and more " * 8, "en", "a", 0, 0),
            (2, "the same text of five words and more " * 8, "en", "b", 0, 0), (None, "no id but a text with letters", None, None, None, None),
            (3, None, "en", "a", 1, 1), (4, "", "de", None, 1, 1), (5, " \n\t ", None, "a", 1, 1), (6, "1234 !!! ???", "en", "a", 1, 1),
            (7, long, "en", "a", 1, 1), (8, "x" * 30_000, "en", "a", 1, 1), (9, "<|endoftext|> ümlaut 日本語 é́ \x00 ok", "de", "a", 1, 1),
            (7, "a tie of ids with another text", "fr", "a", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, score long")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
