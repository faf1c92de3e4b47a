"""The configuration program: pricing against enumeration, the bound and the packing against the least number of sequences."""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pytest

from threadloom.llm import packing


def most_valuable(value, lengths, capacity):
    @cache
    def best(room, i):
        if i == len(lengths):
            return 0.0
        return max(k * value[i] + best(room - k * lengths[i], i + 1) for k in range(room // lengths[i] + 1))

    return best(capacity, 0)


@pytest.mark.parametrize("seed", range(20))
def test_pricing_is_exact(seed):
    rng = random.Random(seed)
    capacity = rng.randrange(5, 40)
    lengths = np.array(sorted(rng.sample(range(1, capacity + 1), rng.randrange(1, min(8, capacity)))))
    value = np.array([rng.random() for _ in lengths])
    top, found = packing.priced(value, lengths, capacity, 0.5)
    assert abs(top - most_valuable(tuple(value), tuple(lengths.tolist()), capacity)) < 1e-9
    assert abs(found[0][0] - top) < 1e-9
    for total, (i, n) in found:
        assert lengths[i] @ n <= capacity and abs(value[i] @ n - total) < 1e-9 and total >= 0.5 * top and (n > 0).all() and (np.diff(i) > 0).all()


def fewest(pieces, capacity):
    """The least number of sequences, by trying every way to fill the next one with the longest piece left."""

    @cache
    def best(left):
        if not left:
            return 0
        fills = {(left[0],)}
        for k, x in enumerate(left[1:], 1):
            fills |= {(*f, x) for f in fills if sum(f) + x <= capacity}
        out = len(left)
        for f in fills:
            rest = list(left)
            for x in f:
                rest.remove(x)
            out = min(out, 1 + best(tuple(rest)))
        return out

    return best(tuple(sorted(pieces, reverse=True)))


@pytest.mark.parametrize("seed", range(25))
def test_bound_and_packing(seed):
    rng = random.Random(100 + seed)
    capacity = rng.choice([10, 17, 30])
    pieces = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
    lengths, counts = np.unique(pieces, return_counts=True)
    made = packing.make_plan(lengths, counts, capacity)
    least = fewest(pieces, capacity)
    assert made.bound <= least + 1e-9 and least <= made.sequences <= least + 1


@pytest.mark.parametrize(("low", "high", "n"), [(1, 2048, 20_000), (1025, 1025, 500), (683, 684, 3000), (200, 900, 6000), (2048, 2048, 3)])
def test_large_histograms_come_near_the_bound(low, high, n):
    pieces = np.random.default_rng(1).integers(low, high + 1, n)
    lengths, counts = np.unique(pieces, return_counts=True)
    made = packing.make_plan(lengths, counts)
    assert pieces.sum() / 2048 - 1e-6 <= made.bound <= made.sequences <= 1.01 * made.bound + 2
    filled = np.zeros(made.sequences, np.int64)
    for x, count, each, sequence in zip(made.plan.length, made.plan.count, made.plan.each, made.plan.sequence, strict=True):
        filled[sequence : sequence + count] += each * x
    assert filled.sum() == pieces.sum() and filled.max() <= 2048 and filled.min() > 0


def test_no_lengths():
    made = packing.make_plan(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert made.sequences == 0 and len(made.plan.length) == 0
