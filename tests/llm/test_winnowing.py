from __future__ import annotations

import random
import re

import numpy as np
import pytest
from llm.conftest_llm import rows_of

from adpulse.llm import winnowing


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item_id, item in items:
            own = words_of(item)
            n = min(len(own), 10)
            windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(item_id)} - {"None"}
        out.append((doc_id, len(words), len(hit), sorted(found)))
    return out


def key(r):
    return [(x is not None, x if x is not None else 0) for x in r]


ITEMS = [(1, "One"), (2, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (10, "x B c d e f g h i j k l m"),
         (3, None), (4, " .. "), (None, "same text"), (5, "w w w w w w w w w w w w"), (6, "é ñ,ß"), (7, "b c d")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def check(docs, rows, items):
    got = rows_of(winnowing.rate(docs, items), "doc_id", "n_words", "n_hit", "items")
    assert got == sorted(brute(rows, ITEMS), key=key)


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_tables(request, table, items):
    docs = request.getfixturevalue(table)
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], items)


def test_random_texts(make_docs, items):
    rnd = random.Random(9)
    parts = ["a b c d e f g h i j k", "B c d e F g h i j k l", "w w w w", "one", "é ñ ß", "same, text", "q", "x", "b c d e f g h i j"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(200)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1])]
    check(make_docs(rows), rows, items)
    clean = winnowing.clean(make_docs(rows), items)
    assert clean.columns == make_docs([]).columns
    assert rows_of(clean, "doc_id") == sorted((d,) for d, _, n, _ in brute(rows, ITEMS) if not n)


def test_no_benchmark(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in winnowing.rate(odd_docs, none).collect()} == {0}
    assert winnowing.clean(odd_docs, none).count() == odd_docs.count()


def test_every_shared_window_shares_a_fingerprint():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        shared = rnd.integers(0, 6, 10, dtype=np.uint64)
        texts = [np.concatenate([rnd.integers(0, 6, rnd.integers(0, 30), dtype=np.uint64), shared,
                                 rnd.integers(0, 6, rnd.integers(0, 30), dtype=np.uint64)]) for _ in range(2)]
        a, b = (set(winnowing.fingerprints(x, 10, 5, 6)[1].tolist()) for x in texts)
        assert a & b
