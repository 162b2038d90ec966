import pytest
from pyspark.sql import functions as F

import public_tokenizers

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(30_000))


#: Names of results and of columns that operators use inside.
CLASHES = [
    "ids", "score", "spans", "kept", "component_id", "piece", "length", "label", "key", "n", "node", "sketch", "added", "of", "base",
    "_part", "_number", "_key", "_row", "_spans", "_text", "_value", "_dir", "_k0", "_id", "pooled", "rank", "weight",
]


@pytest.fixture(scope="session")
def vocabulary_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, None),
        (2, ""),
        (3, "   \n\t \n"),
        (4, "one two"),
        (5, LONG),
        (6, "Write to a.b@mail.example.com, 10.0.0.1 or +1 (743) 555-3824 soon. " * 20),
        (6, "Write to a.b@mail.example.com, 10.0.0.1 or +1 (743) 555-3824 soon. " * 20),
        (None, "a text without an id " * 15),
        (8, "日本語 😀 <|endoftext|> é\x1c\x85 end"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
