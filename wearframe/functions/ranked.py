"""Ranks among counted values: how many past scores are below, and which one is k-th, without keeping every score.

Scores are counted on a grid. Counts live in blocks of neighbouring grid values; a Fenwick tree over the blocks finds the block of a rank and keeps up with
additions in logarithmic time, and a block never holds more than a bounded number of values. What is kept grows with the number of different grid values.
"""

from bisect import bisect_left, bisect_right
from collections.abc import Iterable


class RankedCounts:
    """Multiset of grid values. Blocks are named by the lowest value they may hold, so a changed block can be stored by itself."""

    SIZE = 256

    def __init__(self, grid: float, blocks: Iterable[tuple[int, list[int], list[int]]] = ()):
        self.grid = grid
        stored = sorted(blocks) or [(0, [], [])]
        self.lows = [b[0] for b in stored]
        self.values = [list(b[1]) for b in stored]
        self.counts = [list(b[2]) for b in stored]
        self.changed: set[int] = set()
        self._rebuild()

    def _rebuild(self):
        sums = [sum(c) for c in self.counts]
        self.total = sum(sums)
        self.tree = [0] * (len(sums) + 1)
        for i, n in enumerate(sums, 1):
            self.tree[i] += n
            up = i + (i & -i)
            if up <= len(sums):
                self.tree[up] += self.tree[i]

    def key(self, score: float) -> int:
        return round(score / self.grid)

    def add(self, key: int):
        """Counts one more grid value (not below 0)."""
        b = bisect_right(self.lows, key) - 1
        values, counts = self.values[b], self.counts[b]
        at = bisect_left(values, key)
        self.changed.add(self.lows[b])
        if at < len(values) and values[at] == key:
            counts[at] += 1
        else:
            values.insert(at, key)
            counts.insert(at, 1)
            if len(values) > 2 * self.SIZE:
                self.lows.insert(b + 1, values[self.SIZE])
                self.values.insert(b + 1, values[self.SIZE:])
                self.counts.insert(b + 1, counts[self.SIZE:])
                del values[self.SIZE:], counts[self.SIZE:]
                self.changed.add(self.lows[b + 1])
                self._rebuild()
                return
        self.total += 1
        i = b + 1
        while i < len(self.tree):
            self.tree[i] += 1
            i += i & -i

    def below(self, key: int) -> int:
        """How many counted values are smaller than ``key``."""
        b = bisect_right(self.lows, key) - 1
        n = sum(self.counts[b][:bisect_left(self.values[b], key)])
        while b > 0:
            n += self.tree[b]
            b -= b & -b
        return n

    def kth(self, k: int) -> int:
        """The k-th smallest grid value, from 1."""
        b, step = 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if b + step < len(self.tree) and self.tree[b + step] < k:
                b += step
                k -= self.tree[b]
            step >>= 1
        for value, n in zip(self.values[b], self.counts[b]):
            k -= n
            if k <= 0:
                return value
        raise IndexError("rank beyond the values counted")

    def blocks(self, only_changed=False) -> list[tuple[int, list[int], list[int]]]:
        return [(low, v, c) for low, v, c in zip(self.lows, self.values, self.counts) if not only_changed or low in self.changed]
