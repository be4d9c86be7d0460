from __future__ import annotations

import math
import random

import pytest

from adpulse.llm.packing import Packer


def brute(lengths, capacity, held):
    """The rules written out, with plain searches: a list of (document, start, length,
    sequence, offset) in the order of placing."""
    used, closed, open_bins, kept, out = [], set(), {}, [], []

    def put(d, start, length, seq):
        out.append((d, start, length, seq, used[seq]))
        used[seq] += length

    def new(gap=True):
        used.append(0)
        if gap:
            closed.add(len(used) - 1)
        return len(used) - 1

    def gaps():
        return sorted((capacity - used[s], s, used[s]) for s in closed if used[s] < capacity)

    def to_class(d, start, length):
        j = next(j for j in range(1, capacity + 1) if capacity / (j + 1) < length <= capacity / j)
        if j not in open_bins:
            open_bins[j] = [new(gap=False), 0]
        put(d, start, length, open_bins[j][0])
        open_bins[j][1] += 1
        if open_bins[j][1] == j:
            closed.add(open_bins.pop(j)[0])

    def to_gap(d, start, length):
        for room, seq, _ in gaps():
            if room >= length:
                put(d, start, length, seq)
                return True
        return False

    def cut(d, start, end):
        while start < end:
            g = gaps()
            if g:
                length = min(g[-1][0], end - start)
                put(d, start, length, g[-1][1])
            elif end - start >= capacity:
                length = capacity
                put(d, start, length, new())
            else:
                kept.append((d, start, end - start))
                return
            start += length

    for d, n in enumerate(lengths):
        if n > capacity:
            cut(d, 0, n)
        else:
            kept.append((d, 0, n))
        while sum(x for *_, x in kept) > held * capacity:
            e, start, m = kept.pop(0)
            if sum(g[0] for g in gaps()) <= held * capacity // 2:
                to_class(e, start, m)
            elif not to_gap(e, start, m):
                cut(e, start, start + m)
    closed.update(seq for seq, _ in open_bins.values())
    open_bins.clear()
    items, left = sorted(kept, key=lambda x: (x[1] > 0, -x[2])), sum(x for *_, x in kept)
    kept.clear()
    for d, start, n in items:
        if not to_gap(d, start, n):
            if left > sum(g[0] for g in gaps()):
                put(d, start, n, new())
            else:
                cut(d, start, start + n)
        left -= n
    assert not kept
    return out, used


@pytest.mark.parametrize("capacity", [1, 2, 16, 100])
def test_packer_follows_the_rules(capacity):
    rnd = random.Random(capacity)
    for most in (max(1, capacity // 3), capacity, 5 * capacity):
        for n in (0, 1, 7, 60, 500):
            lengths = [rnd.randint(1, rnd.choice([most, 3, capacity])) for _ in range(n)]
            if n == 500:  # much room waits in gaps
                lengths = [max(1, x - 1 if x * 2 < capacity else x // 2 + 1) for x in lengths] if most == capacity else lengths
            packer = Packer(capacity, 1)
            for d, x in enumerate(lengths):
                packer.add(d, x)
            packer.end()
            want, used = brute(lengths, capacity, 4 * math.isqrt(capacity) + 4)
            assert [(d, s, x, seq, at) for d, s, x, _, seq, at in packer.placed] == want
            assert len(used) == packer.sequences and max(used, default=0) <= capacity
            assert packer.sequences * capacity - sum(lengths) < capacity


@pytest.mark.parametrize("lengths", [[600] * 3000, [700, 350] * 2000, [1024] * 50 + [513] * 2000, [1500] * 900, [5] * 9000])
def test_less_than_a_sequence_is_padding(lengths):
    packer = Packer(1024)
    for d, x in enumerate(lengths):
        packer.add(d, x)
    packer.end()
    assert sum(x[2] for x in packer.placed) == sum(lengths)
    assert packer.sequences * 1024 - sum(lengths) < 1024


def test_classes_hold_a_fixed_count():
    """Without long documents and with little room waiting, bins of class j get j."""
    packer = Packer(1000, 1)
    for d in range(800):
        packer.add(d, (400, 300, 210)[d % 3])
    counts = {}
    for d, _, length, _, seq, _ in packer.placed:
        counts.setdefault(seq, []).append(length)
    closed = [c for s, c in counts.items() if s not in {x[0] for x in packer.open.values()}]
    assert closed and all(len(set(c)) == 1 and len(c) == {400: 2, 300: 3, 210: 4}[c[0]] for c in closed)
