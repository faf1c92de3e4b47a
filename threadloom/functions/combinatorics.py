"""Exact counts of direction arrangements, in Python integers.

A pattern is a string of ``O`` and ``I``; an arrangement has ``o`` times O and ``i`` times I in ``r`` runs. Counts come
from generating functions of run lengths: n runs of one letter, of which each is at least as long as some least
length and ``f`` are free to be longer, share a total of t letters in C(t - least + f - 1, f - 1) ways, and choosing s
letters in a run of free length has the series x**s / (1 - x)**(s + 1).
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache
from math import comb

LETTERS = "OI"


def binomial(n: int, k: int) -> int:
    """0 where nothing can be chosen."""
    return comb(n, k) if 0 <= k <= n else 0


def falling_factorial(v: int, k: int) -> int:
    out = 1
    for s in range(k):
        out *= v - s
    return out


def run_count(pattern: str) -> int:
    return sum(1 for i, x in enumerate(pattern) if i == 0 or pattern[i - 1] != x)


def transition_count(pattern: str) -> int:
    return max(0, run_count(pattern) - 1)


def _shares(total: int, least: int, free: int) -> int:
    """Ways to deal ``total`` letters to runs that need ``least`` together and of which ``free`` may have more."""
    return binomial(total - least + free - 1, free - 1) if free else int(total == least)


def _openings(r: int) -> list[str]:
    """The letters of ``r`` alternating runs, from either start."""
    return [(LETTERS * r)[s : s + r] for s in (0, 1)] if r else [""]


def arrangement_count(o: int, i: int, r: int) -> int:
    """A: arrangements of o and i letters with r runs."""
    return sum(_shares(o, runs.count("O"), runs.count("O")) * _shares(i, runs.count("I"), runs.count("I")) for runs in _openings(r))


def _ahead(pattern: str, at: int, letter: str) -> int:
    """How many ``letter``s the pattern has in a row from ``at`` on."""
    n = 0
    while at + n < len(pattern) and pattern[at + n] == letter:
        n += 1
    return n


def admitting_count(pattern: str, o: int, i: int, r: int) -> int:
    """S: arrangements that hold the pattern as a subsequence.

    Matching as early as possible, a run takes as many pattern letters as it can. If it takes fewer than the pattern
    offers, its length is fixed; else it is free from that length on.
    """
    total = 0
    for runs in _openings(r):
        # (letters matched, least O, free O, least I, free I) -> ways
        states = {(0, 0, 0, 0, 0): 1}
        for letter in runs:
            after: dict[tuple, int] = defaultdict(int)
            for (at, lo, fo, li, fi), ways in states.items():
                offered = _ahead(pattern, at, letter)
                for took in range(1 if offered else 0, offered + 1):
                    free, least = int(took == offered), max(1, took)
                    key = (at + took, lo + least, fo + free, li, fi) if letter == "O" else (at + took, lo, fo, li + least, fi + free)
                    if key[1] <= o and key[3] <= i:
                        after[key] += ways
            states = after
        total += sum(ways * _shares(o, lo, fo) * _shares(i, li, fi) for (at, lo, fo, li, fi), ways in states.items() if at == len(pattern))
    return total


def _chosen(total: int, runs: int, letters: int, empty: int) -> int:
    """Lengths of ``runs`` runs with ``letters`` chosen in them, ``empty`` of which have none chosen."""
    return binomial(total - empty + runs - 1, letters + runs - 1) if runs else int(total == 0 and letters == 0)


def embedding_count(pattern: str, o: int, i: int, r: int) -> int:
    """P: pairs of an arrangement and a place of the pattern in it."""
    total = 0
    for runs in _openings(r):
        states = {(0, 0, 0): 1}  # (letters placed, O runs without any, I runs without any)
        for letter in runs:
            after: dict[tuple, int] = defaultdict(int)
            for (at, eo, ei), ways in states.items():
                for took in range(_ahead(pattern, at, letter) + 1):
                    after[at + took, eo + (letter == "O" and not took), ei + (letter == "I" and not took)] += ways
            states = after
        want = pattern.count("O"), pattern.count("I")
        total += sum(ways * _chosen(o, runs.count("O"), want[0], eo) * _chosen(i, runs.count("I"), want[1], ei) for (at, eo, ei), ways in states.items() if at == len(pattern))
    return total


def squared_embedding_count(pattern: str, o: int, i: int, r: int) -> int:
    """Q: over all arrangements, the sum of the squared number of places of the pattern.

    Two places together choose s letters of a run if they choose t and u with s = t + u - (those chosen by both).
    """
    total = 0
    for runs in _openings(r):
        states = {(0, 0, 0, 0, 0, 0): 1}  # (placed first, placed second, chosen O, chosen I, empty O, empty I)
        for letter in runs:
            after: dict[tuple, int] = defaultdict(int)
            for (a, b, so, si, eo, ei), ways in states.items():
                for t in range(_ahead(pattern, a, letter) + 1):
                    for u in range(_ahead(pattern, b, letter) + 1):
                        for s in range(max(t, u), t + u + 1):
                            w = ways * comb(s, t) * comb(t, s - u)
                            if w:
                                key = (a + t, b + u, so + s, si, eo + (not s), ei) if letter == "O" else (a + t, b + u, so, si + s, eo, ei + (not s))
                                after[key] += w
            states = after
        n = len(pattern)
        total += sum(w * _chosen(o, runs.count("O"), so, eo) * _chosen(i, runs.count("I"), si, ei) for (a, b, so, si, eo, ei), w in states.items() if a == b == n)
    return total


def exchangeable_admitting_count(pattern: str, o: int, i: int) -> int:
    """Arrangements with any number of runs that hold the pattern."""

    @cache
    def ways(left_o: int, left_i: int, at: int) -> int:
        if at == len(pattern):
            return comb(left_o + left_i, left_o)
        out = 0
        if left_o:
            out += ways(left_o - 1, left_i, at + (pattern[at] == "O"))
        if left_i:
            out += ways(left_o, left_i - 1, at + (pattern[at] == "I"))
        return out

    if o + i < 400:
        return ways(o, i, 0)
    return sum(admitting_count(pattern, o, i, r) for r in range(o + i + 1))


#: The places kept of a decimal reading, and the significant digits of a probability.
READING_SCALE, PROBABILITY_DIGITS = 10**12, 12


def decimal_reading(numerator: int, denominator: int) -> float:
    """The ratio cut off (never rounded) after 12 decimals; 0 over nothing."""
    if not denominator:
        return 0.0
    cut = abs(numerator) * READING_SCALE // abs(denominator) / READING_SCALE
    return -cut if numerator * denominator < 0 else cut


def sign_test(observations: int, concordant: int) -> tuple[int, int, str] | None:
    """(numerator, exponent, reading) of the chance of so many concordant ones or more among fair coins."""
    if not observations:
        return None
    numerator = sum(comb(observations, k) for k in range(concordant, observations + 1))
    return numerator, observations, render_probability(numerator, observations)


def render_probability(numerator: int, exponent: int) -> str:
    """numerator / 2**exponent in scientific notation, cut off after 12 significant digits."""
    if not numerator:
        return "0"
    power, whole = 0, 1 << exponent
    while numerator * 10**power < whole:
        power += 1
    digits = str(numerator * 10 ** (power + PROBABILITY_DIGITS - 1) // whole)
    power -= len(digits) - PROBABILITY_DIGITS
    digits = digits[:PROBABILITY_DIGITS]
    return f"{digits[0]}.{digits[1:]}e{'-' if power >= 0 else '+'}{abs(power):02d}" if power else f"{digits[0]}.{digits[1:]}e+00"


def weighted_assignments(sizes: list[int], picks: int) -> int:
    """Order-preserving assignments of ``picks`` messages to positions that hold so many assets each."""
    ways = [1] + [0] * picks
    for size in sizes:
        for j in range(picks, 0, -1):
            ways[j] += ways[j - 1] * size
    return ways[picks]


def qr_band(s: int, a: int) -> str:
    """The band of the share s / a, by integer comparison."""
    if s == 0:
        return "0"
    if s == a:
        return "1"
    for label, test in (("<=0.05", 20 * s <= a), ("<=0.25", 4 * s <= a), ("<=0.5", 2 * s <= a), ("<=0.75", 4 * s <= 3 * a), ("<=0.95", 20 * s <= 19 * a)):
        if test:
            return label
    return "<1"
