from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from llm.conftest_llm import rows_of

from adpulse.llm import simhash


def brute_print(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    """Component id per row of (doc_id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    groups: dict = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            groups[find(i)] = min(groups.get(find(i), d), d)
    return [(d, f"{p:016x}", groups.get(find(i))) for i, (d, p) in enumerate(prints)]


def key(r):
    return [(x is not None, x if x is not None else 0) for x in r]


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_tables(request, table):
    docs = request.getfixturevalue(table)
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute_components(prints, 3), key=key)


def test_near_copies_of_the_documents(spark, make_docs):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(150)) for _ in range(20)]
    rows = []
    for text in base:
        for _ in range(15):
            words = text.split()
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = rnd.choice("xyz")
            rows.append((len(rows), " ".join(words)))
    docs = make_docs(rows)
    prints = [(d, brute_print(t)) for d, t in rows]
    want = sorted(brute_components(prints, 3))
    assert len({w[2] for w in want}) < 250
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert [r[0] for r in rows_of(kept, "doc_id")] == sorted({w[2] for w in want})


def clustered(n):
    """Fingerprints around few centres, so that many cells are shared."""
    rnd = random.Random(7)
    centres = [rnd.getrandbits(64) for _ in range(5)]
    found = set()
    while len(found) < n:
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(64)
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize("cell_rows", [20_000, 40])
def test_every_component_is_found(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    fps = clustered(400)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.fp: r.root for r in simhash.components(prints, 3).collect()}
    want = brute_components(list(enumerate(fps)), 3)
    groups: dict = {}
    for s, (_, _, c) in zip(signed, want):
        groups.setdefault(c, set()).add(got[s])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_manhattan_is_a_lower_bound():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rnd.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 2000, dtype=np.uint64))
    counts = lambda x: np.array([[int(v) >> (2 * s) & 3 for s in range(32)] for v in x])
    manhattan = np.abs(np.bitwise_count(counts(a).astype(np.uint8)).astype(int)
                       - np.bitwise_count(counts(b).astype(np.uint8)).astype(int)).sum(axis=1)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_a_repeated_row_is_kept_once(odd_docs):
    got = simhash.first_of_each(odd_docs).collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in odd_docs.collect()]
    assert len(got) == len({simhash.fingerprint(r.text or "", 3) for r in got})
    assert {f"{simhash.fingerprint(r.text or '', 3):016x}" for r in got} <= {p for _, p, _ in brute_components(prints, 3)}
