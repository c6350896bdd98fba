import pytest

#: doc_id, text, lang, source, n_chars and a column that clashes with results and working names
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, word string, host string"


def rows():
    words = " ".join(f"word{i % 97} Thing{i % 13}," for i in range(300))
    other = " ".join(f"other{i * 7 % 101} piece{i % 17}." for i in range(300))
    return [
        (1, words, "en", "a", 1),
        (2, words, "en", "a", 1),
        (2, words, "en", "a", 1),  # a repeated row
        (3, words.replace("word5 ", "swapped "), "en", "a", 1),
        (4, other, "en", "b", 1),
        (5, "", "en", "b", 0),
        (6, None, None, None, None),
        (7, "two words", "en", "a", 1),
        (8, " \t\n ", "en", None, 1),
        (9, "line one here\nline one here\nline one here\nline two here now", "en", "b", 1),
        (None, "no id at all", "en", "a", 1),
        (None, None, None, None, None),
        (10, "it's 'RE they'll  \n\n 12½ ٣ naïve “q” <|endoftext|> end ", "en", "c", 1),
        (10, "the same id but another text", "en", "c", 1),
        (11, ("long text " + other + " ") * 40, "en", "a", 1),
        (12, "x" * 30_000, "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, "f", "w", "h") for r in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (9, 0, 0), (7, 0, 1), (99, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
