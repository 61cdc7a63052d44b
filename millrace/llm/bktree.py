"""A BK-tree over bit fingerprints: children are keyed by their Hamming distance to the parent."""

from __future__ import annotations

import numpy as np


class BKTree:
    """Built one fingerprint after the other, then searched for many at once."""

    def __init__(self, words: np.ndarray):
        """words: distinct fingerprints, one row of unsigned 64-bit words each."""
        self.words = words
        ints = [int.from_bytes(w.tobytes(), "little") for w in words]
        children: list[dict[int, int]] = [{} for _ in ints]
        for i, x in enumerate(ints[1:], 1):
            at = 0
            while True:
                d = (x ^ ints[at]).bit_count()
                below = children[at].get(d)
                if below is None:
                    children[at][d] = i
                    break
                at = below
        self.first = np.cumsum([0, *map(len, children)])
        self.edge = np.fromiter((d for c in children for d in c), np.int64, self.first[-1])
        self.child = np.fromiter((n for c in children for n in c.values()), np.int64, self.first[-1])

    def near(self, queries: np.ndarray, radius: int, chunk: int = 256):
        """Yields (query rows, node rows) within the radius, a bounded number of queries at a time.

        From a node at distance d only edges within d - radius .. d + radius are followed.
        """
        for start in range(0, len(queries), chunk):
            block = queries[start : start + chunk]
            q, node = np.arange(len(block)), np.zeros(len(block), np.int64)
            found = []
            while len(q) and len(self.words):
                d = np.bitwise_count(block[q] ^ self.words[node]).sum(axis=1, dtype=np.int64)
                hit = d <= radius
                found.append((q[hit] + start, node[hit]))
                n = self.first[node + 1] - self.first[node]
                at = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, d = np.repeat(q, n), np.repeat(d, n)
                follow = np.abs(self.edge[at] - d) <= radius
                q, node = q[follow], self.child[at[follow]]
            if found:
                yield np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def local_components(size: int, links) -> np.ndarray:
    """The smallest row reachable from each of ``size`` rows over blocks of links (a, b)."""
    root = np.arange(size)
    for a, b in links:
        pairs = np.unique(np.minimum(root[a], root[b]) * size + np.maximum(root[a], root[b]))
        for x, y in zip((pairs // size).tolist(), (pairs % size).tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
    return root
