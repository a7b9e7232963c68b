"""Suffix arrays by prefix doubling, to the whole length or to a depth, and permuted common prefixes, in whole-array steps.

Suffixes are ranked by as many first symbols as fit one integer, then again and
again by two ranks, the second that of the suffix where the first ends, so each
round doubles the symbols that count.  Only suffixes whose rank others share
take part in a round.  A group, a second rank and a place are sorted as one
64-bit number, so no round sorts by an index.
"""

from __future__ import annotations

import numpy as np


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def _packed(group: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, which ascends, and ``low``, and where equal pairs begin in it; in parts where a pair and a place don't fit 64 bits."""
    n, first = len(group), group[0]
    low_bits, place_bits = int(low.max()).bit_length(), (n - 1).bit_length()
    if int(group[-1] - first).bit_length() + low_bits + place_bits > 64:
        cut = int(group.searchsorted(group[n // 2])) or int(group.searchsorted(group[n // 2], "right"))
        (one, begin), (two, later) = _packed(group[:cut], low[:cut]), _packed(group[cut:], low[cut:])
        return np.concatenate([one, two + cut]), np.concatenate([begin, later])
    key = (group - first).astype(np.uint64)
    key <<= np.uint64(low_bits)
    key |= low.astype(np.uint64)
    key <<= np.uint64(place_bits)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    key >>= np.uint64(place_bits)
    return order, _starts(key)


def _placed(new: np.ndarray, kind: type) -> np.ndarray:
    """For each place the first of its group."""
    begin = np.flatnonzero(new).astype(kind)
    return np.repeat(begin, np.diff(begin, append=kind(len(new))))


def suffix_ranks(symbols: np.ndarray, k: int, depth: int, left: np.ndarray | None = None) -> np.ndarray:
    """For each position the rank of its suffix by the first ``depth`` symbols, from 1, equal ones alike; symbols are 0 to ``k`` - 1.

    A suffix comes before those that it begins.  With ``left``, how many symbols each may use, only
    positions with ``depth`` of them are ranked; what the others get has no meaning.
    """
    n = len(symbols)
    kind = np.int64 if n >= 1 << 31 else np.int32
    bits, place_bits = k.bit_length(), max(1, n - 1).bit_length()
    known = max(1, min((64 - place_bits) // bits, depth))
    padded = np.zeros(n + known, np.uint64)
    padded[:n] = symbols
    padded[:n] += np.uint64(1)
    key = np.zeros(n, np.uint64)
    for j in range(known):
        key <<= np.uint64(bits)
        key |= padded[j : n + j]
    del padded
    key <<= np.uint64(place_bits)
    key |= np.arange(n, dtype=np.uint64)
    if left is not None:
        key = key[left >= known]
    key.sort()
    at = (key & np.uint64((1 << place_bits) - 1)).astype(kind)
    key >>= np.uint64(place_bits)
    new = _starts(key)
    del key
    place = _placed(new, kind) + kind(1)
    rank = np.zeros(n + 1, kind)  # the last one stands for no suffix
    rank[at] = place
    while known < depth:
        step, known = min(known, depth - known), min(2 * known, depth)
        shared = ~(new & np.append(new[1:], True))
        if left is not None:
            shared &= left[at] >= known
        at, place = at[shared], place[shared]
        if not len(at):
            break
        first = _starts(place)
        order, new = _packed(np.cumsum(first, dtype=kind), rank.take(at + kind(step), mode="clip"))
        at = at[order]
        # groups keep their stretches, so a place in its group adds to the group's rank
        place += _placed(new, kind) - _placed(first, kind)
        rank[at] = place
    return rank[:-1]


def suffix_array(symbols: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (0 to ``k`` - 1) in order; a suffix comes before those that it begins."""
    sa = np.empty(len(symbols), np.int64)
    sa[suffix_ranks(symbols, k, len(symbols)) - 1] = np.arange(len(symbols))
    return sa


def span_array(symbols: np.ndarray, k: int, span: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array to a depth: starts with ``span`` of ``left`` symbols in the order of these, and a number for each interval of equal ones."""
    at = np.flatnonzero(left >= span)
    if not len(at):
        return at, at
    order, new = _packed(np.zeros(len(at), np.int64), suffix_ranks(symbols, k, span, left)[at])
    return at[order], np.cumsum(new) - 1


def permuted_common_prefixes(symbols: np.ndarray, sa: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position the symbols that its suffix shares with the one before it in ``sa``, at most ``left`` of it.

    ``left`` falls by one from a position to the next, or rises where a new part
    begins.  Only where the symbols before two neighbours differ, or a part
    begins, is a prefix compared; after that it is one shorter at each step.
    """
    n, kind = len(symbols), sa.dtype
    before = np.full(n, -1, kind)
    before[sa[1:]] = sa[:-1]
    head = np.ones(n, bool)
    inner = np.flatnonzero((before[1:] > 0) & (left[1:] < left[:-1])) + 1
    head[inner] = symbols[inner - 1] != symbols[before[inner] - 1]
    del inner
    at = np.flatnonzero(head).astype(kind)
    before, own = before[at], left[at]
    shared = np.zeros(len(at), kind)
    wide = np.concatenate([symbols.astype("<u2"), np.full(4, 0xFFFF, "<u2")])
    words = np.ndarray(n + 1, "<u8", wide.data, strides=(2,))
    live = np.flatnonzero(before >= 0)
    while len(live):
        here, there = at[live] + shared[live], before[live] + shared[live]
        going = (here + 4 <= n) & (there + 4 <= n) & (shared[live] < own[live])
        live, here, there = live[going], here[going], there[going]
        live = live[words[here] == words[there]]
        shared[live] += 4
    # what is left of a comparison that ended within four symbols
    live = np.flatnonzero(before >= 0)
    for _ in range(4):
        here, there = at[live] + shared[live], before[live] + shared[live]
        going = (here < n) & (there < n)
        live, here, there = live[going], here[going], there[going]
        live = live[symbols[here] == symbols[there]]
        shared[live] += 1
    del before, own, live
    ends = at + shared  # a prefix that is one shorter at each step ends where it began to end
    whole = np.repeat(ends, np.diff(at, append=n))
    whole -= np.arange(n, dtype=kind)
    np.maximum(whole, 0, out=whole)
    return np.minimum(whole, left.astype(kind))
