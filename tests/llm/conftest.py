import pytest
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, blanks, no letters, a very long text, one very long word, repeated rows and ids, odd characters.
ODD = [
    (None, None, None, None, None),
    (None, "a text without an id that has more than five words", "en", None, None),
    (1, None, "en", "s", 0),
    (2, "", None, "s", 0),
    (3, " \t\n\r \n", "en", None, 5),
    (4, "123 456 -- !!", None, None, None),
    (5, "one", "en", "s", 3),
    (6, "word " * 40_000, "en", "s", 200_000),
    (7, "x" * 150_000, "en", "s", 150_000),
    (8, "the same row twice, with some more words in it", "en", "s", 46),
    (8, "the same row twice, with some more words in it", "en", "s", 46),
    (8, "the same id, but another text with its own words", "de", "s", 48),
    (9, "naïve café Ünïcode 漢字 😀     words \u0000 end", "fr", "s", 40),
    (10, "a\nb\na\n\n\nb\nA\n", "en", "s", 13),
]


@pytest.fixture
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(odd: DataFrame) -> DataFrame:
    """The same rows with extra columns named like what the operators use or return."""
    from pyspark.sql import functions as F

    names = ("dkey", "_row", "removed", "deduped", "rejected", "n_hit", "items", "contaminated", "node", "label", "kept", "rank", "score", "key", "_text", "p_toxic", "features", "fa", "line", "token")
    return odd.withColumns({n: F.lit(f"own {n}") for n in names})
