from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORDS = "the of and to in that is was he for it with as his on be at by had not".split()
LONG = " ".join(WORDS[i * i % 20] + str(i % 97) for i in range(60_000))
TEXTS = [
    (1, "Hello the world, it is what it was.", "en", "a"), (2, "Hello  the world,\nit is what it was. ", "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, " \t\n\x0b\x0c\r ", "fr", "b"),
    (6, LONG, "en", "a"), (7, "Voilà l'été déjà fini, où êtes-vous?", "fr", "b"), (7, "Voilà l'été déjà fini, où êtes-vous?", "fr", "b"), (8, "<|endoftext|> x <|endoftext|>", None, "c"), (None, "no id here at all", "en", None),
    (None, "no id here at all", "en", None), (9, "12345 !!! --- 678", "en", "c"), (10, "漢字 テスト 🙂 ﬁn Σίσυφος", "zz", "c"), (11, "one", "en", "a"), (12, "one two", "en", "a"), (13, LONG + " tail", "en", "a"),
    (14, "Write to jo.doe@mail.example.com or +1 (415) 555-2671 from 10.0.0.1 with 4539 1488 0343 6467 now", "en", "a"),
]
#: Names that operators use inside; they must not matter as further columns of a table.
CLASHES = "id fp digest kept score chunk word node gone_0 lang_pred held data tokens row part component_id spans rare n text_ norm points".split()


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    """Nulls, empty and blank texts, very long ones, ties, repeated rows, odd characters, and clashing names."""
    rows = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit(f"x{k}") for k, c in enumerate(CLASHES)}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs: DataFrame) -> DataFrame:
    return docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SMALL}/documents.parquet")
