from __future__ import annotations

import pytest
from pyspark.sql import types as T

from adpulse.llm.common import ship

# Columns that operators might use themselves.
EXTRA = ["row_id", "kept", "n_words", "spans", "fingerprint", "component_id", "shard", "part", "key"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in EXTRA]])


@pytest.fixture(autouse=True)
def shipped(spark):
    """Workers find the package wherever the tests are started."""
    ship(spark)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns of clashing names."""
    def make(rows):
        return spark.createDataFrame(
            [(d, t, (None, "en", "fr")[i % 3], (None, "src0", "src1")[i % 3],
              None if t is None else len(t), *EXTRA) for i, (d, t) in enumerate(rows)], SCHEMA)
    return make


ODD_TEXTS = [None, "", " \n\t ", "one", "it's  a\n\n two  spaces\x0b", "a\x00b \x1c c", "日本語 テキスト 漢字。",
             "éé ñ ß İ ſ", "word " * 3000, "x" * 20000, "same text", "same text", "same text",
             "+1 (555) 555-0100 a@b.co 1.2.3.4 4111 1111 1111 1111", "<|endoftext|> <s>", "\U0001f600 ok"]


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rows = list(enumerate(ODD_TEXTS)) + [(None, "no id"), (None, None), (3, "one"), (3, "one"), (3, "other")]
    return make_docs(rows)


@pytest.fixture
def no_docs(make_docs):
    return make_docs([])
