"""Runs of windows that share a key, such that equal windows have equal keys wherever they stand.

A window of ``span`` bytes has as its key the least hash of its pieces of
``piece`` bytes.  Neighbouring windows mostly share it, so a text is a row of
runs of about ``(span - piece) / 2`` windows.  In a run longer than that the
piece with the least hash recurs; it is cut where that piece begins, so that
periodic text gives equal short runs.
"""

from __future__ import annotations

import numpy as np

#: Odd numbers, so powers have inverses modulo 2**64: for pieces and for whole contents; and the multiplier that mixes sums.
_BASES, _MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
#: Windows of a run that is cut, at least.
_LEAST = 64


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Sums:
    """Polynomial sums of a buffer, whose differences are hashes of its parts; tables of powers are kept and grow with the largest buffer."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def take(self, data: np.ndarray) -> None:
        if len(self.up) < len(data):
            self.up, self.down = _powers(self.base, len(data)), _powers(self.inverse, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def hashes(self, ends: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hashes from the sums at both ends of the parts and the powers of their first bytes."""
        out = (ends - starts) * first
        out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
        return out


class WindowRuns:
    """Runs of the texts in a buffer."""

    def __init__(self, span: int, piece: int):
        if not 0 < piece <= span:
            raise ValueError(f"pieces of {piece} bytes in windows of {span}")
        self.span, self.piece = span, piece
        self.pieces, self.contents = map(_Sums, _BASES)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """``text, start, windows, key, content, within`` of the runs of the texts between these places of ``data``.

        Starts count from the text's; ``content`` is a hash of all bytes of the
        run's windows, so it and ``key``, independent of it, tell contents apart.
        ``within`` is false where no window of the run can be equal to another of it.
        """
        none = (np.empty(0, np.int64),) * 6
        if len(data) < self.span:
            return none
        self.pieces.take(data)
        sums = self.pieces.sums
        hashes = self.pieces.hashes(sums[self.piece :], sums[: -self.piece], self.pieces.down[: len(data) - self.piece + 1])
        width = self.span - self.piece + 1
        least, size = hashes, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(hashes) - width + 1], least[width - size :])
        windows = np.maximum(ends - starts - self.span + 1, 0)
        text = np.repeat(np.arange(len(starts)), windows)
        if not len(text):
            return none
        at = np.arange(len(text)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
        key = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        length = np.diff(first, append=len(at))
        cuts = [first]
        for i in np.flatnonzero(length > width):
            begin = at[first[i]]
            anchors = np.flatnonzero(hashes[begin : begin + length[i]] == key[first[i]])
            cut, more = 0, []
            while (k := np.searchsorted(anchors, cut + _LEAST)) < len(anchors):
                cut = int(anchors[k])
                more.append(first[i] + cut)
            cuts.append(np.array(more, np.int64))
        if len(cuts) > 1:
            first = np.sort(np.concatenate(cuts))
            length = np.diff(first, append=len(at))
        text, begin = text[first], at[first]
        self.contents.take(data)
        sums, end = self.contents.sums, begin + length + self.span - 1
        content = self.contents.hashes(sums[end], sums[begin], self.contents.down[begin])
        key = key[first]
        return text, begin - starts[text], length, key.view(np.int64), content.view(np.int64), self._recurring(hashes, key)

    def _recurring(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether a key's piece begins twice within a run's reach, or its hash is too large to say.

        Only the least hashes are looked through, so many of them that nearly every window has some.
        """
        width = self.span - self.piece + 1
        bound = np.uint64(min((1 << 64) - 1, (12 << 64) // width))
        at = np.flatnonzero(hashes <= bound)
        order = np.argsort(hashes[at], kind="stable")
        ordered, at = hashes[at][order], at[order]
        twice = (ordered[1:] == ordered[:-1]) & (at[1:] - at[:-1] <= 2 * self.span)
        return (keys > bound) | np.isin(keys, ordered[1:][twice])
