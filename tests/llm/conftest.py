import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, spark  # noqa: F401  (one session for all tests)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, ids=None, more=""):  # noqa: F811
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)
    for c in more.split():
        df = df.withColumn(c, F.lit("other"))
    return df


ODD = [None, "", " \t\n", "one", "A b C d e", "A b C d e", "İstanbul ΑΣ café café x́ 漢字 ½ don't I'LL", "a<|endoftext|>b <|startoftext|>",
       "\x1c \x85 a b 😀🏽", "word " * 3000, "long" * 5000, "x  y\n\n z ", "#$% *** the end"]


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    """Null, empty, blank, repeated, special and very long texts; a null and a repeated id; clashing columns."""
    ids = [*range(len(ODD) - 2), None, 3]
    return docs_of(spark, ODD, ids, "fp kept n_tokens ids tree edits grade n_words rule length __digest Start")


@pytest.fixture(scope="session")
def none(spark):  # noqa: F811
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):  # noqa: F811
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")
