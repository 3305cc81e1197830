import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, key string, spans string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, lang, source) tuples, with extra columns whose names operators use inside."""
    def build(rows, partitions=3):
        full = [(i, t, lang, src, len(t or ""), "s", "f", "k", "x") for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    chance = random.Random(11)
    words = "the of and to in a is that it for was on are as with his they at be this".split()

    def text(n):
        return " ".join(chance.choice(words) for _ in range(n))

    shared = text(80)
    long = "\n".join(text(40) for _ in range(900))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\v\f\r ", None, None), (4, shared, "en", "a"), (5, shared.upper(), "en", "b"),
            (6, text(30) + " " + shared + " " + text(30), "en", None), (7, "Ünïcödé ÀÉ\x85x\xa0y #$% 漢字 <|endoftext|>", "fr", "b"),
            (8, long, "en", "a"), (9, long + " end", "en", "a"), (None, shared, None, "a"), (None, None, None, None),
            (10, text(25), "en", "b"), (10, text(26), "en", "b"), (11, shared, "en", "a"), (11, shared, "en", "a"), (12, "one two", "en", "a")]
    return rows + [(20 + i, text(60), "en", "ab"[i % 2]) for i in range(20)]


@pytest.fixture(scope="session")
def small_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
