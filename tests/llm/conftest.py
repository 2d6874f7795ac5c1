from __future__ import annotations

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} item{i % 13}" for i in range(40_000))
ODD = [
    (1, None, "en", "s", None), (2, "", None, "s", 0), (3, "   \n\t ", "en", None, 5),
    (4, "one", "en", "s", 3), (5, "one", "en", "s", 3), (5, "one", "en", "s", 3),
    (6, "It is said that ähnlich wörter and 漢字 and 😀 stay whole in every text of this kind, always.", "de", "s", 9),
    (7, LONG, "en", "s", len(LONG)), (8, LONG, "en", "s", len(LONG)), (9, "x" * 300_000, "en", "s", 300_000),
    (None, "a row without an id that is long enough to be kept by all of the rules of the ledger, "
           "as it has more than twenty words in it", "en", "s", 1),
    (10, "1.2.3.4.5.6.7.8 a@b.c%d@e.f +1 (234) 555-0000 4539 5787 6362 1486 <|startoftext|> <s> ▁ ▁▁", "en", "s", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named as the operators name theirs."""
    names = ("_key", "_text", "_row", "_hash", "class", "n", "block", "part", "id", "kept", "rank", "piece",
             "failures", "n_words", "component", "_bucket", "_next", "_words", "length", "start", "offset",
             "sequence_id", "kind", "good", "n_tokens", "ids", "score")
    return odd.withColumns({c: F.lit("x") for c in names})
