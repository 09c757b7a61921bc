"""Indexes by the Burrows-Wheeler transform.

FMIndex: BWT in a wavelet matrix, backward search, sampled suffix positions.
RunIndex: run-compressed BWT with sampled run ends, which give the longest match
of every suffix with the one before it in order.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of non-negative integers by prefix doubling; a text's end sorts first.

    The first sort takes as many symbols as fit into 62 bits. Later ones take
    only suffixes that still share their rank with another.
    """
    n = len(s)
    bits = max(1, int(s.max(initial=0) + 1).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(min(step, n)):
        key[: n - k] |= (s[k:].astype(np.int64) + 1) << (bits * (step - 1 - k))
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    act = sa[~(new & np.append(new[1:], True))]
    while len(act):
        far = act + step
        key = rank[act] * (n + 1) + np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        act, k = act[o], key[o]
        base, i = rank[act], np.arange(len(act))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], base[1:] != base[:-1]]), i, 0))
        new = np.concatenate([[True], k[1:] != k[:-1]])
        sub = np.maximum.accumulate(np.where(new, i, 0))
        sa[base + i - group] = act
        rank[act] = base + sub - group
        act = act[~(new & np.append(new[1:], True))]
        step *= 2
    return sa


class WaveletMatrix:
    """rank(c, i): how often symbol c is among the first i; vectorised over c and i."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []
        now = symbols
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            one = (now >> bit) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((ones, len(now) - int(ones[-1])))
            hit = one.astype(bool)
            now = np.concatenate([now[~hit], now[hit]])
        self.bits = len(self.levels)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros(len(c), np.int64)
        hi = i.astype(np.int64)
        for level, (ones, zeros) in enumerate(self.levels):
            bit = (c >> (self.bits - 1 - level)) & 1
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo = np.where(bit, zeros + a, lo - a)
            hi = np.where(bit, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Over `text`, symbols 1..size-1 and separators 0. No pattern holds a separator."""

    def __init__(self, text: np.ndarray, size: int, rate: int = 8) -> None:
        n = len(text)
        gap = text == 0
        # Separators differ from each other and sort before all else, so that no match runs across one.
        distinct = np.where(gap, np.cumsum(gap), text + int(gap.sum()) + 1)
        sa = suffix_array(distinct)
        bwt = text[sa - 1]
        self.size, self.n = size, n
        self.wavelet = WaveletMatrix(bwt, size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        # Sampled: every rate-th position, and those that follow a separator, where walking on would leave the run.
        kept = (sa % rate == 0) | (bwt == 0)
        self.bwt = bwt
        self.kept = kept
        self.at = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
        self.sample = sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [lo, hi) of patterns (rows, padded on the right)."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((hi > lo) & (lengths > back))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - back]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.first[c] + both[: len(live)]
            hi[live] = self.first[c] + both[len(live) :]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        row, walked = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[row])
        while len(todo):
            c = self.bwt[row[todo]]
            row[todo] = self.first[c] + self.wavelet.rank(c, row[todo])
            walked[todo] += 1
            todo = todo[~self.kept[row[todo]]]
        return self.sample[self.at[row]] + walked


class RunIndex:
    """Run-compressed BWT of a text of distinct separators and bytes.

    Kept are, for each run, its symbol, its first row, and the text positions
    at its two ends. Where two rows next to each other have the same symbol in
    front, their matches are one shorter than those a position earlier; so
    matches are compared at run ends only, and streamed from there.
    """

    def __init__(self, text: np.ndarray) -> None:
        sa = suffix_array(text)
        bwt = np.where(sa > 0, text[sa - 1], -1)  # in front of the first position stands nothing
        new = np.ones(len(sa), bool)
        new[1:] = bwt[1:] != bwt[:-1]
        row = np.flatnonzero(new)
        self.n, self.symbol, self.row = len(sa), bwt[row], row
        self.head = sa[row]
        self.tail = sa[np.append(row[1:], len(sa)) - 1]

    def matching(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position: length of the match with the suffix before it in order, and where that one is (-1: none)."""
        i, j = self.head[1:], self.tail[:-1]
        # The first row of all has no suffix before it.
        at, other = np.append(i, self.head[0]), np.append(j, -1)
        longest = np.append(common_prefix(text, i, j), 0)
        mark = np.full(self.n, -1, np.int64)
        mark[at] = np.arange(len(at))
        source = np.maximum.accumulate(np.where(mark >= 0, np.arange(self.n), 0))
        k = mark[source]
        step = np.arange(self.n) - source
        return np.maximum(longest[k] - step, 0), np.where(other[k] >= 0, other[k] + step, -1)


def common_prefix(text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of common prefixes of suffixes i and j (j of -1: none)."""
    n = len(text)
    padded = np.concatenate([text, [-1, -2]])
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(j >= 0)
    while len(live):
        a, b = np.minimum(i[live] + out[live], n), np.minimum(j[live] + out[live], n)
        same = (padded[a] == padded[b]) & (a < n) & (b < n)
        live = live[same]
        out[live] += 1
    return out
