"""Numbers of n-grams against numpy's, and their time."""

import time
import tracemalloc

import numpy as np
import pytest

from citewell.llm import ppm
from citewell.llm.ppm import Tally, coded_grams, gathered, numbered, spread


def grams(n, seed=0):
    r = np.random.default_rng(seed)
    return r.zipf(1.3, n) % (1 << 40) | (1 << 56)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 100_000])
def test_numbers(n):
    gram = grams(n, n)
    different, number = numbered(spread(gram))
    assert (gathered(different)[number] == gram).all()
    assert sorted(gathered(different).tolist()) == np.unique(gram).tolist()


def test_values_that_share_upper_bits():
    values = np.array([5, 4, 5, 1 << 63, 4, 6], np.uint64)
    different, number = numbered(values)
    assert (different[number] == values).all() and set(different.tolist()) == set(values.tolist())


def test_time():
    """Numbering by an index of the values, as before, takes more than twice as long."""
    gram = grams(1 << 21)

    def took(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    best = [min(took(run) for _ in range(3)) for run in (lambda: numbered(spread(gram)), lambda: np.unique(gram, return_inverse=True))]
    assert best[0] < 0.8 * best[1]


def held_beside(run):
    """The most bytes that ``run`` holds at once, beside what was there."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_numbering():
    """N-grams of a block, from bytes to numbers, take no more than four 64-bit values a byte at once (6.6 before)."""
    r = np.random.default_rng(0)
    bodies = [r.integers(97, 123, 1 << 12).astype(np.uint8).tobytes() for _ in range(512)]
    most = held_beside(lambda: numbered(spread(coded_grams([b"\n"] * len(bodies), bodies, 6))))
    assert most < 4 * 8 * sum(map(len, bodies))


def test_memory_of_a_tally():
    """Runs are merged a range at a time: what is held beside the runs is less than these (3.4 times as much before)."""
    r = np.random.default_rng(1)
    tally = Tally()
    tally.keys, tally.counts = np.unique(r.integers(1, 1 << 50, 1 << 20)), np.ones(1 << 20, np.int64)
    for _ in range(4):
        keys = np.unique(r.integers(1, 1 << 50, 1 << 18))
        tally.new.append((keys, np.ones(len(keys), np.int32)))
    runs = sum(k.nbytes + n.nbytes for k, n in [(tally.keys, tally.counts), *tally.new])
    total = []
    assert held_beside(lambda: total.append(sum(int(n.sum()) for _, n in tally.merged()))) < runs
    assert total == [len(tally.keys) + sum(len(k) for k, _ in tally.new)]


@pytest.mark.parametrize("size", [1, 5, 300, 1 << 17])
def test_tally_counts(size):
    """Against numpy, over few values many times and many once; what is written a range at a time is in order."""
    grams = grams_of(size)
    tally = Tally()
    for a in range(0, len(grams), max(1, size // 7)):
        tally.add(grams[a : a + max(1, size // 7)].copy())
    keys, n = (np.concatenate(x) for x in zip(*tally.merged(), strict=True))
    want = np.unique(grams, return_counts=True)
    assert (keys == want[0]).all() and (n == want[1]).all()
    tally.merge()
    assert (tally.keys == want[0]).all() and (tally.counts == want[1]).all() and not tally.new


def grams_of(size):
    return np.concatenate([grams(size), np.arange(size) << 20 | 1 << 56])


def test_cut_bodies_have_the_contexts_of_whole_ones(monkeypatch):
    """Bodies, short, empty and longer than what is worked on at once, against n-grams byte by byte."""
    r = np.random.default_rng(2)
    sizes = [0, 1, 3, 40, 0, 7, 129, 64, 0]
    leads = [b"\n", b"\n", b"abcdef", b"\n", b"xyzuvw", b"\n", b"ghijkl", b"\n", b"\n"]
    bodies = [r.integers(97, 123, n).astype(np.uint8).tobytes() for n in sizes]
    want = []
    for lead, body in zip(leads, bodies, strict=True):
        whole = lead + body
        for i in range(len(lead), len(whole)):
            want.append(int.from_bytes(b"\x01" + whole[max(0, i - 6) : i + 1]))
    for cut in (7, 16, 1 << 18):
        monkeypatch.setattr(ppm, "_SLICE", cut)
        assert coded_grams(leads, bodies, 6).tolist() == want


@pytest.mark.parametrize("cut", [1, 3, 64, 1 << 18])
@pytest.mark.parametrize("hot", [0, 20, 1000])
def test_shares_of_owners(monkeypatch, cut, hot):
    """Sums and cold numbers of owners, some without n-grams, against plain loops, whatever is worked on at once."""
    monkeypatch.setattr(ppm, "_SLICE", cut)
    r = np.random.default_rng(3)
    sizes = np.array([0, 5, 0, 0, 190, 1, 64, 0])
    gram = r.integers(1, 80, sizes.sum()).astype(np.int64)
    different, number = numbered(spread(gram))
    hot_gram = np.sort(spread(np.arange(1, 80, dtype=np.int64))[:hot:2])
    hot_lp = -np.arange(1.0, len(hot_gram) + 1)
    lp, cold = ppm._found(different, hot_gram, hot_lp)
    score, colds, numbers = ppm._shares(sizes, number, lp, cold)
    known = dict(zip(gathered(hot_gram).tolist(), hot_lp.tolist(), strict=True))
    rare = gathered(different[cold >= 0]).tolist()
    for i, part in enumerate(np.split(gram, np.cumsum(sizes)[:-1])):
        assert score[i] == pytest.approx(sum(known.get(g, 0.0) for g in part.tolist()))
        mine = numbers[colds[:i].sum() : colds[: i + 1].sum()]
        assert [rare[j] for j in mine] == [g for g in part.tolist() if g not in known]
    assert [np.frombuffer(x, "<u4").tolist() for x in ppm._binary(numbers, colds).to_pylist()] == [x.tolist() for x in np.split(numbers, np.cumsum(colds)[:-1])]
