import pytest

#: Columns whose names clash with those of the operators.
CLASHING = ["n_words", "score", "label", "piece", "length", "kept", "rule"]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang) rows,
    with extra columns that clash."""

    def make(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, *["x"] * len(CLASHING)) for r in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        return spark.createDataFrame(rows, schema + ", ".join(f"{c} string" for c in CLASHING))

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest given tables."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


#: Awkward texts: null, empty, blanks, one word, marks, special strings, long.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "a b c d e"), (6, "<|endoftext|> x <|startoftext|>"),
    (7, "É́ ｆｕｌｌ 日本語 ½ \x1f\x85 ok"), (8, "long " * 30_000), (9, "same text of five words here"),
    (10, "same text of five words here"), (10, "same text of five words here"), (10, "another text under that id now"),
    (None, "a row without an id but text"), (11, "x" * 50_000),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def none_at_all(documents):
    return documents([])


