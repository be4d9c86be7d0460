from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from adpulse.llm import lattice_lm
from adpulse.llm.queries import tokenizer_file

FILE = tokenizer_file("piece_bpe_32k.model")


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute_base(rows):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    train = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    n, v = sum(train.values()), len(train)
    return [(d, h, len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), n,
             sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)))
            for (d, x), h in zip(rows, held)]


def key(r):
    return [(x is not None, x if x is not None else 0) for x in r]


@pytest.mark.parametrize("frequent", [200_000, 3, 1])
@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_base_scores(request, monkeypatch, table, frequent):
    monkeypatch.setattr(lattice_lm, "FREQUENT", frequent)
    monkeypatch.setattr(lattice_lm, "COUNT_ENTRIES", 5)
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted([tuple(r)[:6] for r in lattice_lm.score(docs, FILE).collect()], key=key)
    want = sorted(brute_base(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_without_training_rows(make_docs):
    row = lattice_lm.score(make_docs([(None, "a b")]), FILE).first()
    assert (row.held_out, row.train_tokens, row.n_known) == (True, 0, 0)
    assert row.base_score == pytest.approx(0.0) and row.score < 0


def pieces_of(model):
    sp = lattice_lm.vocabulary(FILE)
    return {sp.id_to_piece(int(i)): (int(i), float(x)) for i, x in zip(model.ids, model.scores)}


def all_ways(model, pieces, text):
    """The sum over every segmentation, one by one, and the expected number of each piece."""
    total, expected = 0.0, Counter()
    for cut in itertools.product([0, 1], repeat=len(text) - 1):
        ends = [i + 1 for i, c in enumerate(cut) if c] + [len(text)]
        used, score = [], 0.0
        for a, b in zip([0, *ends], ends):
            part = text[a:b]
            if part in pieces:
                used.append(pieces[part][0])
                score += pieces[part][1]
            elif len(part) == 1:
                used += [int(model.byte_id[x]) for x in part.encode()]
                score += sum(model.byte[x] for x in part.encode())
            else:
                break
        else:
            total += math.exp(score)
            for i in used:
                expected[i] += math.exp(score)
    return math.log(total), {i: x / total for i, x in expected.items()}


WORDS = ["a", "there", "information", "ouon,", "☃x☃", "漢字a", "été", "", "in", "\U0001f600\U0001f601", "there", "▁▁a"]


def test_marginal_is_the_sum_over_all_segmentations():
    for model in (lattice_lm.Lattice(FILE), lattice_lm.Lattice(FILE, {300: 50, 301: 20, 2000: 7}, 10)):
        pieces = pieces_of(model)
        got = model.log_probabilities(WORDS)
        assert got == pytest.approx([all_ways(model, pieces, "▁" + w)[0] for w in WORDS])
        total = sum(math.exp(x) for _, x in pieces.values()) + sum(map(math.exp, model.byte)) + math.exp(model.end)
        assert total == pytest.approx(1.0)


def test_expected_counts_are_those_of_all_segmentations():
    model = lattice_lm.Lattice(FILE, {300: 50, 301: 20, 2000: 7}, 10)
    pieces, want = pieces_of(model), Counter()
    counts = [1 + i % 4 for i in range(len(WORDS))]
    for w, n in zip(WORDS, counts):
        for i, x in all_ways(model, pieces, "▁" + w)[1].items():
            want[i] += n * x
    got = model.expected(WORDS, np.array(counts, dtype=float))
    assert {i: got[i] for i in np.flatnonzero(got > 1e-12)} == pytest.approx({i: x for i, x in want.items() if x > 1e-12})
    # every character of a word is in one piece
    assert sum(got[i] * len(p) for p, (i, _) in pieces.items() if not p.startswith("<0x")) == pytest.approx(
        sum(n * (1 + len(w)) for w, n in zip(WORDS, counts))
        - sum(n * sum(c not in pieces for c in w) for w, n in zip(WORDS, counts)))


def test_long_words_and_chunks_change_nothing(monkeypatch):
    model = lattice_lm.Lattice(FILE)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeinrst漢é") for _ in range(rnd.choice([1, 5, 9, 70, 300]))) for _ in range(200)] + ["x" * 5000]
    whole, counts = model.log_probabilities(words), model.expected(words, np.ones(len(words)))
    assert np.isfinite(whole).all()
    monkeypatch.setattr(lattice_lm, "TOGETHER", 30)
    monkeypatch.setattr(lattice_lm, "LONG", 8)
    assert model.log_probabilities(words) == pytest.approx(whole)
    assert model.expected(words, np.ones(len(words))) == pytest.approx(counts)


def test_the_models_training_lifts_held_out_text(spark):
    """Counts over all segmentations beat the vocabulary's prior on held-out documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lattice_lm.score(docs, FILE).collect() if r.held_out}
    prior = lattice_lm.Lattice(FILE)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in got}
    before = sum(prior.log_probabilities([w.decode() for w in lattice_lm.words_of(t)]).sum() for t in texts.values()) / math.log(10)
    after = sum(r.score for r in got.values())
    assert len(got) > 50 and after > 0.9 * before


def test_scores_add_up_over_words(make_docs, monkeypatch):
    docs = make_docs([(1, "the cat sat"), (2, "the dog sat down"), (3, "The cat"), (4, "")])
    whole = {r.doc_id: r.score for r in lattice_lm.score(docs, FILE).collect()}
    monkeypatch.setattr(lattice_lm, "FREQUENT", 1)
    assert {r.doc_id: r.score for r in lattice_lm.score(docs, FILE).collect()} == pytest.approx(whole)


def test_held_out_text_scores_better_than_scrambled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rnd = random.Random(3)
    held = [r for r in docs.collect() if lattice_lm.held_out(r.doc_id) and len(r.text) > 50]
    noise = [(10_000_000 + i, "".join(rnd.sample(r.text.replace(" ", ""), len(r.text.replace(" ", "")))))
             for i, r in enumerate(held)]
    noise = [(d, " ".join(t[i:i + 6] for i in range(0, len(t), 6))) for d, t in noise]
    ids = {d for d, _ in noise}
    got = {r.doc_id: r.score for r in lattice_lm.score(docs.union(spark.createDataFrame(noise, docs.schema)), FILE).collect()}
    chars = {r.doc_id: len(r.text.replace(" ", "")) for r in held} | {d: len(t.replace(" ", "")) for d, t in noise}
    real = sorted(got[r.doc_id] / chars[r.doc_id] for r in held)
    scrambled = sorted(got[d] / chars[d] for d in ids)
    assert real[len(real) // 2] > scrambled[len(scrambled) // 2]
