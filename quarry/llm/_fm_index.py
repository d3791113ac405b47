"""FM-index over integer sequences with a wavelet matrix, searched for many patterns in step (numpy)."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_order(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``ends`` is the exclusive end of each position's sequence (suffixes stop there)."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    at, step = np.arange(n), 1
    while True:
        nxt = at + step
        inside = nxt < ends
        second = np.where(inside, rank[np.minimum(nxt, n - 1)], 0)
        # beyond the end of its sequence a suffix is ordered by position, so ties end
        key = rank * (2 * n + 2) + np.where(inside, second + n, np.minimum(at, n))
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        step *= 2


class _Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = int(len(bits) - self.before[-1])

    def ones(self, pos: np.ndarray) -> np.ndarray:
        word = pos >> 6
        part = self.words[word] & ((_U(1) << (pos & 63).astype(np.uint64)) - _U(1))
        return self.before[word] + np.bitwise_count(part)


class FMIndex:
    """Index of several sequences: ``codes`` in a row, each from 1 to ``symbols``; ``lengths`` cuts them."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, symbols: int):
        ends = np.repeat(np.cumsum(lengths), lengths)
        starts = ends - np.repeat(lengths, lengths)
        # each sequence ends with symbol 0, a row of its own in front of all suffixes
        order = suffix_order(codes, ends)
        n, m = len(codes), len(lengths)
        last = np.cumsum(lengths) - 1
        # the end rows take the order of the sequences' positions, as suffix_order breaks ties
        bwt = np.concatenate([codes[last], np.where(order == starts[order], 0, codes[np.maximum(order - 1, 0)])])
        self.size, self.sequences = n + m, m
        self.sequence = np.concatenate([np.arange(m), (np.repeat(np.arange(m), lengths))[order]])
        counts = np.bincount(codes, minlength=symbols + 1)
        counts[0] = m
        self.start = np.concatenate([[0], np.cumsum(counts)])[: symbols + 1]
        self.levels = max(1, int(symbols).bit_length())
        self.rows, cur = [], bwt.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level & 1).astype(bool)
            self.rows.append(_Bits(bit))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.base = self._walk(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))

    def _walk(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.rows):
            one = (symbol >> level & 1).astype(bool)
            ones = bits.ones(pos)
            pos = np.where(one, bits.zeros + ones, pos - ones)
        return pos

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: rows whose suffix is ``symbol`` followed by the pattern of rows [low, high)."""
        shift = self.start[symbol] - self.base[symbol]
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        k = len(symbol)
        return shift + both[:k], shift + both[k:]


class RangeMin:
    """Minimum over index ranges by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while 2 << (len(self.table) - 1) <= len(values):
            prev, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(prev[:-half], prev[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.table[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out
