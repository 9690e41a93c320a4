import pytest
from pyspark.sql import types as T

#: Column names that operators use inside.
CLASHES = ["start", "length", "bucket", "block", "fp", "score", "n", "key", "label", "kept", "spans", "declared", "quality", "toxicity", "kept_id", "_split_key"]


@pytest.fixture(scope="session")
def long_text():
    return " ".join(f"word{i % 977} and\n" if i % 50 == 0 else f"w{i * 7919 % 100003}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark, long_text):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    same = "the same passage of a few words stands here again and again until it is long enough to count"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, long_text), (7, same), (7, same), (8, same), (8, same + " other end"),
        (None, same), (None, None), (9, "<|endoftext|> é   \x1c x"), (10, "\n\n\n"), (11, "A" * 5000), (12, "ÄÖ ß" + "€ " * 100),
    ]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CLASHES]
    )
    return spark.createDataFrame([(i, t, None, None, None, *("x" for _ in CLASHES)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.collect()]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 13)] + [(None, 1, 1), (3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def doc_rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())
