import pytest

from tests.conftest import SMALL

LONG = "Of the longest text, every word counts. " * 30_000
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from here to there"
# Null and empty values, ties, repeated rows, very long texts, and columns that operators use themselves.
ODD = [
    (1, PLAIN, "en", "a"),
    (1, PLAIN, "en", "a"),
    (2, PLAIN, "en", "a"),
    (None, PLAIN, None, None),
    (None, None, None, None),
    (3, None, "de", None),
    (4, "", "de", "b"),
    (5, " \n\t ", "", "b"),
    (6, LONG, "en", "c"),
    (7, LONG + "x", "en", "c"),
    (8, "einzelwort", "de", "c"),
    (9, "Ünïcödé ﬁ \U0001f642\U0001f642 日本語 \x00 <|endoftext|> ▁", "xx", "c"),
    (10, PLAIN.upper(), "en", "d"),
]
CLASHES = (
    "row part place shared kept digest size start node root word key found mark run said text_key drop_key refine_key "
    "x y at count sketch_no sketch_bits hub band low label_id row_key grouped listed ids base cands "
    "n_a n_b links groups number piece length offset sequence_id part_no ids_crc32"
).split()


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with clashing columns."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").repartition(3)
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
