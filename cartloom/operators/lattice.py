"""Candidates as a prefix trie in arrays, and what a task counts with it.

Sorted candidates of k items are the leaves of a trie of depth k: candidates with the same first items share a path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Leaves whose bitmaps are held at a time.
LEAVES = 1024


@dataclass(frozen=True)
class Trie:
    """items[d] and parents[d]: for the nodes of depth d + 1 their item and the place of their parent in depth d. order: which row each leaf is."""

    items: list[np.ndarray]
    parents: list[np.ndarray]
    order: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.items, *self.parents, self.order))


def trie(rows: np.ndarray) -> Trie:
    """The trie of distinct rows (n, k) of item numbers, each row ascending in the order that its depth has."""
    n, k = rows.shape
    order = np.lexsort(rows.T[::-1]) if n else np.zeros(0, np.int64)
    rows = rows[order]
    items, parents, new = [], [], np.zeros(n, bool)
    if n:
        new[0] = True
    above = np.zeros(n, np.int64)
    for d in range(k):
        new = new | np.append(n > 0, rows[1:, d] != rows[:-1, d])[:n]
        items.append(rows[new, d])
        parents.append(above[new])
        above = np.cumsum(new) - 1
    return Trie(items, parents, order)


def squeezed(bits: np.ndarray, worth: int) -> np.ndarray:
    """Bitmaps (a row for each item) without the positions that no item has, if these are most of them and the bitmaps are used worth times their number."""
    used = np.bitwise_or.reduce(bits, axis=0) if len(bits) else np.zeros(bits.shape[1], np.uint64)
    have = int(np.bitwise_count(used).sum())
    if worth < 4 * len(bits) or 2 * have > 64 * bits.shape[1]:
        return bits
    keep = np.flatnonzero(np.unpackbits(used.view(np.uint8)))
    width = max(1, -(-len(keep) // 64)) * 8
    out = np.zeros((len(bits), width), np.uint8)
    for a in range(0, len(bits), 256):
        packed = np.packbits(np.unpackbits(bits[a : a + 256].view(np.uint8), axis=1)[:, keep], axis=1)
        out[a : a + 256, : packed.shape[1]] = packed
    return out.view(np.uint64)


def count_bitmaps(t: Trie, bits: np.ndarray) -> tuple[np.ndarray, int]:
    """How many positions each leaf's items share, and how many bitmaps were ANDed for it.

    A prefix is ANDed once for all candidates that begin with it; below an empty one nothing is. bits has a row for each
    item number; a last row of zeros stands for unknown items.
    """
    k, n = len(t.items), len(t.order)
    counts, work = np.zeros(n, np.int64), 0
    if k == 1:
        return np.bitwise_count(bits[t.items[0]]).sum(1).astype(np.int64), 0
    for a in range(0, n, LEAVES):
        # the nodes above a block of leaves are a range in each depth
        spans = [(a, min(n, a + LEAVES))]
        for d in range(k - 1, 0, -1):
            lo, hi = spans[0]
            spans.insert(0, (int(t.parents[d][lo]), int(t.parents[d][hi - 1]) + 1))
        held, alive = bits[t.items[0][slice(*spans[0])]], None
        alive = held.any(1)
        for d in range(1, k):
            lo, hi = spans[d]
            up = t.parents[d][lo:hi] - spans[d - 1][0]
            go = np.flatnonzero(alive[up])
            both = held[up[go]] & bits[t.items[d][lo:hi][go]]
            work += len(go)
            if d == k - 1:
                counts[lo + go] = np.bitwise_count(both).sum(1)
            else:
                held = np.zeros((hi - lo, bits.shape[1]), np.uint64)
                held[go] = both
                alive = held.any(1)
    return counts, work


def count_transactions(t: Trie, items: np.ndarray, ends: np.ndarray, universe: int) -> tuple[np.ndarray, int]:
    """How many transactions hold each leaf's items, and how many nodes were met.

    items: the item numbers of the transactions, ascending in each, one transaction after another; ends: where each ends. All
    transactions go down the trie together, a depth at a time: a state is a node and the place of its item.
    """
    last = np.repeat(ends, np.diff(np.append(0, ends)))
    where, node, work = np.arange(len(items)), np.zeros(len(items), np.int64), 0
    for d in range(len(t.items)):
        keys = t.parents[d] * universe + t.items[d]  # ascending, as nodes are sorted
        if d:
            room = last[where] - where - 1
            place = np.repeat(where + 1, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
            asked = np.repeat(node, room) * universe + items[place]
        else:
            place, asked = where, items.astype(np.int64)
        at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
        hit = np.flatnonzero(keys[at] == asked) if len(keys) else np.zeros(0, np.int64)
        where, node = place[hit], at[hit]
        work += len(hit)
    return np.bincount(node, minlength=len(t.order)), work


def pair_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For two blocks of bit-packed columns (a row of bits for each column) the product of the 0/1 matrices: how many positions each pair shares."""
    total = np.zeros((len(left), len(right)), np.int64)
    a, b = left.view(np.uint8), right.view(np.uint8)
    for x in range(0, a.shape[1], 2048):  # 16,384 positions: sums stay exact in single precision
        total += (np.unpackbits(a[:, x : x + 2048], axis=1).astype(np.float32) @ np.unpackbits(b[:, x : x + 2048], axis=1).astype(np.float32).T).astype(np.int64)
    return total
