import pytest

DATA = "/root/testdata/sf0.001"
ODD_TEXTS = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, "x" * 50_000), (5, "word " * 30_000), (6, "\x1c \x1f <|endoftext|> é ÀÉ"),
             (None, "a b c d"), (None, None), (7, " \n\t ")]


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [(i, t, None if i == 3 else "en", None if i in (2, 5) else f"s{(i or 0) % 2}", len(t or ""), 1, 2, 3, "x") for i, t in ODD_TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score int, target string")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")
