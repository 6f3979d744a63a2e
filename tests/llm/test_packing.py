"""The plan over a histogram of lengths against best-two-fit one bin and one piece at a time."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlark.llm.packing import plan


def one_by_one(lengths, capacity):
    """Every bin as a sorted tuple of lengths: filled greedily, then its smallest piece given for the best two."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        one, gap = [], capacity
        for n in list(left):
            if n <= gap:
                one.append(n)
                left.remove(n)
                gap -= n
        if gap:
            small = one[-1]
            fit = [(a + b, -b, a) for i, a in enumerate(sorted(left)) for b in sorted(left)[i + 1 :] if a + b <= gap + small]
            total, b, a = max(fit, default=(0, 0, 0))  # of equal sums that with the shortest longer one
            if total > small:
                one.remove(small)
                left.append(small)
                for n in (a, -b):
                    left.remove(n)
                    one.append(n)
                left.sort(reverse=True)
        bins.append(tuple(sorted(one)))
    return bins


def planned(lengths, capacity):
    """The plan's bins; ranks of a length must be used once each and offsets be gapless."""
    bins, ranks = {}, Counter()
    for n, first, times, sequence, offset in plan(Counter(lengths), capacity):
        assert first == ranks[n]
        ranks[n] += times
        for k in range(times):
            bins.setdefault(sequence + k, []).append((offset, n))
    assert ranks == Counter(lengths)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return [tuple(sorted(n for _, n in bins[k])) for k in sorted(bins)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_is_best_two_fit(lengths):
    assert sorted(planned(lengths, 30)) == sorted(one_by_one(lengths, 30))


@pytest.mark.parametrize("lengths", [[], [30], [16] * 50, [10, 10, 10] * 7 + [29] * 5 + [1] * 3, [17, 9, 8, 7, 6, 5] * 6])
def test_plan_on_repeats(lengths):
    assert sorted(planned(lengths, 30)) == sorted(one_by_one(lengths, 30))
