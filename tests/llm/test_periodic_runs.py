from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from adpulse.llm import periodic_runs, queries
from adpulse.llm.periodic_runs import find_runs


def brute_runs(words, least=24, times=3):
    """All maximal stretches of each period, those of a smaller period left out."""
    n, out = len(words), []
    for q in range(1, n):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - start
            own = words[start:start + length]
            smaller = any(all(own[j] == own[j - d] for j in range(d, length)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts, **kw):
    ids = np.array([x for t in texts for x in t], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = [[] for _ in texts]
    for start, length, period in find_runs(ids, text, **kw).tolist():
        out[text[start]].append((start - int(starts[text[start]]), length, period))
    return out


def some_texts(rnd, n):
    """Few letters, and roots repeated with breaks, which make many near runs."""
    out = []
    for _ in range(n):
        letters = rnd.choice([1, 2, 2, 3, 5, 40])
        t = []
        while len(t) < rnd.choice([0, 5, 24, 60, 200, 400]):
            root = [rnd.randrange(letters) for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 33, 64]))]
            t += (root * rnd.choice([1, 1, 2, 3, 4, 9]))[:rnd.choice([10, 23, 24, 25, 70, 300])]
            if rnd.random() < 0.4:
                t.append(rnd.randrange(letters))
        out.append(t)
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (1, 3), (10, 4), (7, 3)])
def test_runs_equal_brute_force(least, times):
    texts = some_texts(random.Random(least * times), 150)
    texts += texts[:3]  # equal texts behind each other
    got = runs_of(texts, least=least, times=times)
    for t, own in zip(texts, got):
        assert own == brute_runs(t, least, times), t


def test_every_short_text_over_two_letters():
    texts = [[(x >> i) & 1 for i in range(n)] for n in range(1, 12) for x in range(1 << n)]
    for t, own in zip(texts, runs_of(texts, least=4, times=3)):
        assert own == brute_runs(t, 4, 3), t


def test_one_word_very_often_takes_no_square():
    t0 = time.time()
    assert runs_of([[7] * 1_000_000]) == [[(0, 1_000_000, 1)]]
    root = list(range(1000)) * 2 + [5]  # a square inside the root
    assert runs_of([root * 300]) == [[(0, 300 * len(root), len(root))]]
    assert time.time() - t0 < 60


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError):
        runs_of([[1]], times=2)


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (None,) * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("table", ["odd_docs", "no_docs", "planted"])
def test_digests(request, make_docs, spark, tmp_path, table):
    if table == "planted":
        rnd = random.Random(3)
        ids = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0] + list(range(20)) + [-3, None]
        docs = make_docs([(d, rnd.choice(["", " ", "\n"]).join(["", *(rnd.choice(["a ", "b\t", "é\x0b\n", "漢 "])
                                                                     for _ in range(rnd.choice([1, 9, 60, 200]))), " "]))
                          for d in ids])
    else:
        docs = request.getfixturevalue(table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple((x is not None, x or 0) for x in r[:1]) + tuple(map(str, r[1:]))
    got = sorted((tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((brute_row(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert table == "no_docs" or any(r[1] for r in got)


def test_whole_results(odd_docs):
    rows = periodic_runs.periodic_runs(odd_docs).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[8].n_words == 3000 and [tuple(x) for x in by[8].runs] == [(0, 3000, 1)] and by[8].collapsed == "word"
    assert by[0].collapsed == "" and by[4].collapsed == "it's a two spaces" and by[5].collapsed == "a\x00b \x1c c"
