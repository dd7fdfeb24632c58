from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="session")
def vocabulary_path():
    from eventscope.llm.queries import vocabulary_path

    return vocabulary_path()


@pytest.fixture
def docs(spark):
    """Rows ``(doc_id, text)`` as a table with extra columns, some named like the operators' own."""
    from pyspark.sql import functions as F

    def make(rows, parts=3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        for name in ("kept", "ids", "spans", "row", "body", "node", "key", "hash", "score"):
            df = df.withColumn(name, F.lit(name))
        return df

    return make
