"""An FM-index over a sequence of small integers, with a wavelet matrix, in numpy.

Symbol 0 separates the runs of the sequence; patterns hold none. All searches are vectorised over
the patterns of one length.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Each separator counts as smaller than all other
    symbols and unlike every other separator, so no comparison goes on beyond a run."""
    n = len(text)
    breaks = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(breaks)
    rank[breaks] = np.arange(len(breaks))
    step = 1
    while True:
        key = rank * np.int64(rank.max() + 2)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """Rank and access over symbols below `sigma`, a prefix count of ones for each bit level."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        left = symbols.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            flag = (left >> bit) & 1
            count = np.zeros(len(left) + 1, np.int32)
            np.cumsum(flag, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(left) - int(count[-1]))
            left = np.concatenate([left[flag == 0], left[flag == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbols >> bit) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = (ones[at + 1] - ones[at]).astype(bool)
            out = out * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search and locate. `text` must end with a separator (0)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16) -> None:
        order = suffix_order(text)
        last = text[order - 1]  # of suffix 0, the final separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(last, sigma)
        # Starts of runs are sampled too, so a walk never steps through a separator.
        kept = (order % sample == 0) | (last == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of `patterns` the range of suffixes that begin with it."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.first[-1], np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            symbol = patterns[open_, column].astype(np.int64)
            low[open_] = self.first[symbol] + self.wavelet.rank(symbol, low[open_])
            high[open_] = self.first[symbol] + self.wavelet.rank(symbol, high[open_])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to the next sampled suffix and add the steps."""
        out = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            kept = self.kept_before[at + 1] > self.kept_before[at]
            out[open_[kept]] = self.sampled[self.kept_before[at[kept]]] + steps
            open_, at = open_[~kept], at[~kept]
            symbol = self.wavelet.access(at)
            at = self.first[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out
