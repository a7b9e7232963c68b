"""Suffix arrays to a depth against sorting, and their time against a sort of as many numbers."""

import random
import time

import numpy as np
import pytest

from citewell.llm.suffix_dedup import repeated_starts
from citewell.llm.suffixes import _packed, span_array


@pytest.mark.parametrize("seed", range(60))
def test_span_array(seed):
    r = random.Random(seed)
    k, span = r.choice([1, 2, 3, 200]), r.randrange(1, 40)
    shared = [r.randrange(k) for _ in range(50)]
    parts = [[r.randrange(k) for _ in range(r.randrange(9))] + shared[r.randrange(50) :] + [0] for _ in range(r.randrange(1, 9))]
    s = [x for p in parts for x in p]
    left = [n for p in parts for n in range(len(p) - 1, -1, -1)]
    sa, interval = span_array(np.array(s, np.uint8), k, span, np.array(left, np.int32))
    strings = [s[i : i + span] for i in sa.tolist()]
    assert sorted(sa.tolist()) == [i for i in range(len(s)) if left[i] >= span]
    assert strings == sorted(strings)
    assert interval.tolist() == [sum(x != y for x, y in zip(strings[:i], strings[1 : i + 1], strict=True)) for i in range(len(strings))]


def test_pairs_that_do_not_fit_with_a_place():
    r = np.random.default_rng(0)
    group = np.sort(np.append(r.integers(0, 1 << 30, 500), [3] * 300))
    low = r.integers(0, 1 << 31, 800)
    low[::7] = 5
    order, new = _packed(group, low)
    pairs = list(zip(group[order].tolist(), low[order].tolist(), strict=True))
    assert pairs == sorted(pairs) and sorted(order.tolist()) == list(range(800))
    assert new.tolist() == [i == 0 or pairs[i] != pairs[i - 1] for i in range(800)]


@pytest.mark.parametrize("segment", [b"a" * 100_000, b"abcde\n" * 20_000])
def test_time_of_periodic_segments(segment):
    """Induced sorting took 4,000 and 800 times a sort of as many numbers, doubling takes about 15 times."""
    numbers = np.random.default_rng(0).integers(0, 1 << 62, len(segment))

    def took(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    sort = min(took(lambda: [np.sort(numbers) for _ in range(10)]) for _ in range(3)) / 10
    assert min(took(lambda: repeated_starts([segment], [1], 200)) for _ in range(2)) < 200 * sort
    assert repeated_starts([segment], [1], 200).sum() == len(segment) - 199
