from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import types as T

from adpulse.llm import filter_audit

from .conftest_llm import rows_of

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType())])
OUT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))


def brute(docs, labels):
    """Applies every order to every document."""
    rated = {}
    for r in labels:
        good, toxic = rated.get(r[0], (False, False))
        rated[r[0]] = (good or r[1] == 1, toxic or r[2] == 1)
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    least: dict = {}
    for d, t, _ in rows:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    seen = [(p, (*fails(t), d is not None and d > least[t]), *(rated.get(d, (False, False)) if d is not None else (False, False)))
            for d, t, p in rows]
    out, shares = {}, Counter()
    for part in {p for p, *_ in seen}:
        own = [x for x in seen if x[0] == part]
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shares[part, f] += len(gone)
                out[part, "".join("ABCDE"[i] for i in order), step] = (
                    f, len(left), len(gone), sum(x[1][f] for x in own) - len(gone),
                    sum(x[1][f] and sum(x[1]) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return sorted((*k, *v[1:], shares[k[0], v[0]]) for k, v in out.items())


def test_weights_are_shapleys():
    """Against the average of marginal removals over all orders, and efficiency."""
    rnd = random.Random(1)
    for k in range(1, 6):
        weights = filter_audit.shapley_weights(k)
        for _ in range(5):
            v = [0, *(rnd.randint(0, 1000) for _ in range((1 << k) - 1))]
            want = [0] * k
            for order in permutations(range(k)):
                before = 0
                for i in order:
                    want[i] += v[before | 1 << i] - v[before]
                    before |= 1 << i
            got = [sum(w * x for w, x in zip(row, v)) for row in weights]
            assert got == want and sum(got) == factorial(k) * v[-1]


def some_docs(make_docs):
    rnd = random.Random(7)
    words = ["a", "B", "cc", "Dd", "e#", "f", "g", "éÉ", "h|", "i"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choices(words[:rnd.choice([3, 10, 70])], k=rnd.choice([3, 49, 50, 80]))) for _ in range(60)]
    rows = [(i, rnd.choice(texts)) for i in range(150)] + [(None, texts[0]), (None, texts[0]), (3, texts[1]),
                                                          (3, texts[1]), (151, None), (152, ""), (153, " \n")]
    rnd.shuffle(rows)
    return make_docs(rows)


LABEL_ROWS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 140, 3)] + [(3, 0, 1), (6, None, None), (None, 1, 1), (999, 1, 1)]


@pytest.mark.parametrize("table", ["some", "odd_docs"])
def test_equals_every_order_applied(request, spark, make_docs, table):
    docs = some_docs(make_docs) if table == "some" else request.getfixturevalue(table)
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    want = brute(docs, LABEL_ROWS)
    for parts in (1, 6):
        assert rows_of(filter_audit.audit_documents(docs.repartition(parts), labels), *OUT) == want


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(no_docs, none).count() == 0
    assert rows_of(filter_audit.audit_documents(odd_docs, none), *OUT) == brute(odd_docs, [])


def test_other_filters_and_games(spark):
    """The audit takes any masks: three filters, one game, a null part as a part."""
    masks = spark.createDataFrame([("x", 0, 5, True), ("x", 3, 2, False), ("x", 4, 1, True), (None, 7, 9, True)],
                                  "p string, mask int, n long, paid boolean")
    got = filter_audit.audit(masks, ["u", "v", "w"], "p", ["paid"])
    assert got.columns == ["p", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "paid_lost", "shapley"]
    rows = {(r.p, r.filter_order, r.step): r for r in got.collect()}
    assert len(rows) == 2 * 6 * 3
    assert tuple(rows["x", "uvw", 2])[3:] == (6, 0, 2, 0, 0, 6)
    assert tuple(rows["x", "wvu", 1])[3:] == (7, 1, 0, 1, 1, 6)
    assert tuple(rows[None, "vuw", 1])[3:] == (0, 9, 0, 0, 9, 18)
    with pytest.raises(ValueError):
        filter_audit.audit(masks, list("abcdefgh"), "p")
