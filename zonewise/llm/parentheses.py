"""Ordered trees as balanced parentheses, with range min-max blocks over the excess.

A tree is one bit per parenthesis in depth-first order. ``close`` finds the partner of an opening one: in its own block, else in
the next block whose least excess is low enough, which a tree of minima over the blocks finds in logarithmic time. All
positions asked for are answered together, in whole arrays.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    def __init__(self, bits):
        """``bits``: 1 opens, 0 closes; balanced."""
        self.bits = np.asarray(bits, np.int8)
        n = len(self.bits)
        excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        wide = 1
        while wide * BLOCK < n:
            wide *= 2
        # beyond the end nothing is low enough
        self.excess = np.full(wide * BLOCK, np.iinfo(np.int64).max // 2)
        self.excess[:n] = excess
        # level 0 holds the least excess of every block, each level above that of two below
        self.least = [self.excess.reshape(wide, BLOCK).min(1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(1))
        leaf = (self.bits[:-1] == 1) & (self.bits[1:] == 0) if n else np.zeros(0, bool)
        self.opened = np.r_[0, np.cumsum(self.bits == 1)]
        self.leaves = np.r_[0, np.cumsum(leaf), leaf.sum()] if n else np.zeros(1, np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opening parentheses before each position: a node's number in preorder."""
        return self.opened[at]

    def leaf_rank(self, at: np.ndarray) -> np.ndarray:
        """Leaf pairs "()" that begin before each position."""
        return self.leaves[at]

    def close(self, at: np.ndarray) -> np.ndarray:
        """Partner of the opening parenthesis at each position."""
        at = np.asarray(at, np.int64)
        want = self.excess[at] - 1
        out = self._in_block(at // BLOCK, at + 1, want)
        left = np.flatnonzero(out < 0)
        if len(left):
            block = self._next_block(at[left] // BLOCK, want[left])
            out[left] = self._in_block(block, block * BLOCK, want[left])
        return out

    def _in_block(self, block: np.ndarray, start: np.ndarray, want: np.ndarray) -> np.ndarray:
        """First position from ``start`` to the end of the block with at most the wanted excess, or -1."""
        out = np.full(len(block), -1, np.int64)
        for k in range(0, len(block), 1 << 16):
            part = slice(k, k + (1 << 16))
            places = block[part, None] * BLOCK + np.arange(BLOCK)
            low = (self.excess[places] <= want[part, None]) & (places >= start[part, None])
            first = low.argmax(1)
            out[part] = np.where(low.any(1), block[part] * BLOCK + first, -1)
        return out

    def _next_block(self, block: np.ndarray, want: np.ndarray) -> np.ndarray:
        """First block after each with an excess as low as wanted."""
        node, level = block.copy(), np.zeros(len(block), np.int64)
        climbing = np.ones(len(block), bool)
        for k, least in enumerate(self.least):
            # a left child whose sibling is low enough holds the answer on its right
            beside = climbing & (node % 2 == 0) & (node + 1 < len(least))
            hit = np.flatnonzero(beside)
            hit = hit[least[node[hit] + 1] <= want[hit]]
            node[hit] += 1
            level[hit] = k
            climbing[hit] = False
            node[climbing] //= 2
        for k in range(len(self.least) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            left = node[down] * 2
            node[down] = np.where(self.least[k - 1][left] <= want[down], left, left + 1)
            level[down] = k - 1
        return node
