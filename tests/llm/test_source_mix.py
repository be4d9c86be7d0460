from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from adpulse.llm import source_mix
from adpulse.llm.source_mix import Mix, SplittingTree, hypergeometric, permuted, targets


def brute_targets(sizes, weights, most=3):
    """The level x at which the sum of min(most * size, x * weight) is the sum of sizes."""
    total = Fraction(sum(sizes))
    points = sorted(Fraction(most * s, w) for s, w in zip(sizes, weights) if s)
    at = lambda x: sum(min(Fraction(most * s), x * w) for s, w in zip(sizes, weights))
    low = Fraction(0)
    for p in points:
        if at(p) >= total:
            break
        low = p
    rising = sum(w for s, w in zip(sizes, weights) if s and Fraction(most * s, w) > low)
    level = low + (total - at(low)) / rising if rising else low
    return [min(Fraction(most * s), level * w) for s, w in zip(sizes, weights)]


def test_targets_are_water_levels():
    rnd = random.Random(1)
    assert targets([], []) == [] and targets([0, 0], [1, 2]) == [0, 0]
    for _ in range(300):
        n = rnd.randint(1, 9)
        sizes = [rnd.choice([0, 1, 5, 100, 10_000, rnd.randint(1, 1000)]) for _ in range(n)]
        weights = [1 + i % 3 for i in range(n)]
        got = targets(sizes, weights)
        assert got == brute_targets(sizes, weights)
        assert sum(got) == sum(sizes) and all(a <= 3 * s for a, s in zip(got, sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutations_and_back(n):
    numbers = np.arange(n)
    out = permuted(numbers, n, 5)
    assert sorted(out.tolist()) == list(range(n))
    assert permuted(out, n, 5, back=True).tolist() == numbers.tolist()
    assert n < 16 or permuted(numbers, n, 6).tolist() != out.tolist()


def test_hypergeometric_is_the_inverse_distribution():
    for good, bad, draws in [(5, 7, 4), (3, 0, 2), (0, 9, 3), (10, 10, 20), (200, 300, 100), (1, 1000, 999)]:
        total, at = comb(good + bad, draws), 0.0
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            p = comb(good, k) * comb(bad, draws - k) / total
            if p > 1e-9:
                assert hypergeometric(at + p / 2, good, bad, draws) == k
            at += p
    n = 10**11  # the mean, of a large one
    assert abs(hypergeometric(0.5, n, 2 * n, n) - n / 3) < 10


def test_tree_deals_exact_quotas():
    quotas = [0, 1, 50, 1000, 333]
    tree = SplittingTree(quotas, 7, 3)
    at, totals = [0] * 5, []
    for shard in range(7):
        first, n = SplittingTree(quotas, 7, 3).leaf(shard)  # each by itself
        assert (first, n) == tree.leaf(shard) and first == at and min(n) >= 0
        at = [a + b for a, b in zip(at, n)]
        totals.append(sum(n))
    assert at == quotas and max(totals) - min(totals) <= 1
    # over seeds, a leaf gets its share in the mean
    got = [SplittingTree(quotas, 7, seed).leaf(4)[1][3] for seed in range(300)]
    assert abs(np.mean(got) - 1000 / 7) < 3 and np.std(got) > 2


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_docs(make_docs, n=120):
    rnd = random.Random(5)
    rows = [(i if i % 17 else None, " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([0, 1, 7, 40, 300]))))
            for i in range(n)]
    return make_docs([*rows, rows[1], rows[1], (5, None), (900, "long " * 5000)])


@pytest.mark.parametrize("table", ["some", "odd_docs", "no_docs"])
def test_a_mix_is_exact(request, spark, make_docs, table):
    docs = some_docs(make_docs) if table == "some" else request.getfixturevalue(table)
    rows = docs.select("doc_id", "text", "source").collect()
    mix = Mix(docs, n_shards=5, block=16)
    got = mix.taken().collect()
    # documents, sizes, sources and targets as the contract says
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r.doc_id, r.source, len(words(r.text))) for r in rows)
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(r.text)) for r in rows if r.source == s) for s in names]
    want = dict(zip(names, brute_targets(sizes, [1 + i % 3 for i in range(len(names))])))
    for r in got:
        assert r.source_size == sizes[names.index(r.source)] and r.target == float(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
    for s in names:
        assert sum(r.taken for r in got if r.source == s) == int(want[s] + Fraction(1, 2))
    # the draws: every block once a pass, shards alike, passes complete but for the last
    draws = [(d.source_index, d.turn, d.block) for d in mix.draws().collect()]
    assert len(set(draws)) == len(draws)
    shards = Counter(d.shard for d in mix.draws().collect())
    if draws:
        assert max(shards.values()) - min(shards[i] for i in range(5)) <= 1
    for own in mix.sources:
        turns = Counter(t for i, t, _ in draws if i == own.index)
        assert all(n == own.n_blocks for t, n in turns.items() if t < max(turns))
    # the pieces: a place in a line is drawn as often as its block, less the cut
    taken = Counter()
    for p in mix.pieces().collect():
        taken[p.source_index, p.line_start] += p.n_words
        assert 0 < p.n_words <= 16 and p.offset + p.n_words <= 16
    lines = mix.lines.where("size > 0").collect()
    assert len({(r.source_index, r.line_start) for r in lines}) == len(lines)
    by_place = Counter({(r.source_index, r.line_start): 0 for r in lines})
    by_place.update(taken)
    assert sorted(by_place.values()) == sorted(r.taken for r in got if r["size"])
    # the same rows otherwise dealt out give the same mix
    again = Mix(docs.repartition(7), n_shards=5, block=16).taken().collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_the_mix_by_hand(spark, make_docs):
    """Draw after draw in one list, against the pieces of the distributed mix."""
    mix = Mix(some_docs(make_docs, 40), n_shards=3, block=32, seed=2)
    lines = {}
    for r in sorted(mix.lines.where("size > 0").collect(), key=lambda r: (r.source_index, r.line_start)):
        lines.setdefault(r.source_index, []).extend([r.line_start] * r["size"])
    tree, want = SplittingTree([s.n_draws for s in mix.sources], 3, 2), Counter()
    for own in mix.sources:
        line = lines.get(own.index, [])
        blocks = [line[i:i + 32] for i in range(0, len(line), 32)]
        for shard in range(3):
            first, n = (x[own.index] for x in tree.leaf(shard))
            for d in range(first, first + n):
                turn = d // len(blocks)
                block = int(permuted(np.array([d % len(blocks)]), len(blocks), own.pass_key(turn))[0])
                left = blocks[block][:len(blocks[block]) - (own.cut if d == own.n_draws - 1 else 0)]
                want.update((shard, own.index, d, turn, block, place) for place in left)
    got = Counter()
    for p in mix.pieces().collect():
        got[p.shard, p.source_index, p.draw, p.turn, p.block, p.line_start] += p.n_words
    assert got == want
    shuffled = mix.shuffled().collect()
    for shard in range(3):
        own = sorted((p for p in shuffled if p.shard == shard), key=lambda p: p.position)
        assert [p.position for p in own] == list(range(1, len(own) + 1))
        assert [p.draw for p in own] != sorted(p.draw for p in own)


def test_too_many_sources_are_an_error(make_docs, monkeypatch):
    monkeypatch.setattr(source_mix, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="2 sources at most"):
        Mix(some_docs(make_docs, 9))
