"""Exact counts against enumeration of all arrangements and all places of a pattern in them."""

from __future__ import annotations

from itertools import combinations, product
from math import comb

import pytest

from threadloom.functions import combinatorics as exact


def arrangements(o, i):
    for at in combinations(range(o + i), o):
        yield "".join("O" if k in at else "I" for k in range(o + i))


def places(pattern, text):
    return sum("".join(text[k] for k in at) == pattern for at in combinations(range(len(text)), len(pattern)))


def runs(text):
    return sum(k == 0 or text[k] != text[k - 1] for k in range(len(text)))


@pytest.mark.parametrize(("o", "i"), [(o, i) for o in range(6) for i in range(6) if o + i <= 8])
def test_counts_are_those_of_enumeration(o, i):
    every = list(arrangements(o, i))
    by_runs = {r: [x for x in every if runs(x) == r] for r in range(o + i + 2)}
    patterns = ["".join(p) for n in range(5) for p in product("OI", repeat=n)]
    for r, own in by_runs.items():
        assert exact.arrangement_count(o, i, r) == len(own)
    for p in patterns:
        assert exact.exchangeable_admitting_count(p, o, i) == sum(places(p, x) > 0 for x in every)
        for r, own in by_runs.items():
            if own:
                n = [places(p, x) for x in own]
                assert exact.admitting_count(p, o, i, r) == sum(k > 0 for k in n), (p, r)
                assert exact.embedding_count(p, o, i, r) == sum(n), (p, r)
                assert exact.squared_embedding_count(p, o, i, r) == sum(k * k for k in n), (p, r)


def test_small_functions():
    assert [exact.binomial(n, k) for n, k in ((5, 2), (5, 0), (5, 6), (3, -1), (0, 0))] == [10, 1, 0, 0, 1]
    assert exact.falling_factorial(7, 3) == 210 and exact.falling_factorial(7, 0) == 1 and exact.falling_factorial(2, 3) == 0
    assert [exact.run_count(x) for x in ("", "O", "OOI", "OIOI")] == [0, 1, 2, 4] and [exact.transition_count(x) for x in ("", "O", "OIOI")] == [0, 0, 3]
    assert exact.decimal_reading(1, 3) == 0.333333333333 and exact.decimal_reading(-2, 3) == -0.666666666666 and exact.decimal_reading(5, 0) == 0.0


@pytest.mark.parametrize(("n", "k"), [(0, 0), (1, 1), (5, 0), (5, 5), (12, 9), (300, 170)])
def test_sign_test(n, k):
    found = exact.sign_test(n, k)
    if not n:
        assert found is None
        return
    numerator = sum(comb(n, x) for x in range(k, n + 1))
    assert found[:2] == (numerator, n)
    assert abs(float(found[2]) - numerator / 2**n) <= 1e-11 * numerator / 2**n


def test_bands_of_shares():
    a = 1000
    at = {0: "0", 1: "<=0.05", 50: "<=0.05", 51: "<=0.25", 250: "<=0.25", 251: "<=0.5", 500: "<=0.5", 501: "<=0.75", 750: "<=0.75", 751: "<=0.95", 950: "<=0.95", 951: "<1", 999: "<1", 1000: "1"}
    assert {s: exact.qr_band(s, a) for s in at} == at


def test_weighted_assignments():
    for sizes in ([1, 2, 3], [2, 2], [1], [], [3, 1, 4, 1]):
        for picks in range(len(sizes) + 1):
            want = 0
            for at in combinations(range(len(sizes)), picks):
                ways = 1
                for x in at:
                    ways *= sizes[x]
                want += ways
            assert exact.weighted_assignments(sizes, picks) == want
