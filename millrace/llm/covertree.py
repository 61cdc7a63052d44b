"""Cover trees over unit vectors: nested levels whose radii halve, and the traversal of two trees at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: More than rounding moves a distance by.
ROOM = 1e-7


def chord(dots: np.ndarray) -> np.ndarray:
    """The distance between unit vectors of these inner products."""
    return np.sqrt(np.maximum(0, 2 - 2 * dots))


def nested_centers(x: np.ndarray, least: float, most_levels: int = 12) -> np.ndarray:
    """For each vector its center at each level, as row numbers; a row of the result is a vector's way down.

    Level 0 has one center. At each further level the radius halves: a node's own center stays one (nesting), and rows
    of the node that none yet covers become centers in turn. Levels end where the radius is below ``least`` or each
    row is a center.
    """
    n = len(x)
    levels = [np.zeros(n, np.int64)]
    radius = float(chord(x @ x[0]).max(initial=0))
    while radius > least and len(levels) < most_levels and len(np.unique(levels[-1])) < n:
        radius /= 2
        of = np.full(n, -1, np.int64)
        order = np.argsort(levels[-1], kind="stable")
        edges = np.flatnonzero(np.diff(levels[-1][order], prepend=-1))
        for rows in np.split(order, edges[1:]):
            center = levels[-1][rows[0]]
            dots = x[rows] @ x[rows].T
            open_ = np.ones(len(rows), bool)
            at = int(np.flatnonzero(rows == center)[0])
            while True:
                near = open_ & (chord(dots[at]) <= radius)
                near[at] = True
                of[rows[near & open_]] = rows[at]
                open_ &= ~near
                if not open_.any():
                    break
                at = int(open_.argmax())
        levels.append(of)
    return np.stack(levels, axis=1)


class CoverTree:
    """A tree's nodes level by level, from the ways that ``nested_centers`` gave; leaves are single vectors."""

    def __init__(self, x: np.ndarray, ways: np.ndarray, weight: np.ndarray):
        self.x = x
        n, depth = ways.shape
        ways = np.column_stack([ways, np.arange(n)])
        self.order = np.lexsort(ways.T[::-1])
        ways, sorted_x = ways[self.order], x[self.order]
        self.center, self.radius, self.low, self.high, self.kids = [], [], [], [], []
        above = np.zeros(n, np.int64)
        sums = np.concatenate([[0], np.cumsum(weight[self.order])])
        for level in range(depth + 1):
            new = np.flatnonzero((np.diff(above, prepend=-1) != 0) | (np.diff(ways[:, level], prepend=-1) != 0)) if n else np.empty(0, np.int64)
            high = np.append(new[1:], n)
            node = np.repeat(np.arange(len(new)), high - new)
            center = ways[new, level]
            gone = chord(np.einsum("ij,ij->i", sorted_x, x[center][node])) if level < depth else np.zeros(n)
            self.center.append(center)
            self.radius.append(np.maximum.reduceat(gone, new) if n else gone)
            self.low.append(new)
            self.high.append(high)
            if level:
                first = np.searchsorted(new, self.low[level - 1])
                self.kids.append(np.append(first, len(new)))
            above = node
        self.weight = [sums[h] - sums[lo] for lo, h in zip(self.low, self.high, strict=True)]

    @property
    def depth(self) -> int:
        return len(self.center) - 1


def links(a: CoverTree, b: CoverTree, least_dot: float) -> Links:
    """How much weight of the other tree each vector of ``a`` and of ``b`` links with, and edges that join what links.

    Vectors link if their inner product is ``least_dot`` or more; with ``a`` and ``b`` the same tree, each vector
    links with itself as well. A pair of nodes whose centers lie further apart than the reach and both radii is left; one
    whose vectors all lie within reach counts as a whole, with one edge between the centers and, once a node, one from
    each of its vectors to its center; the others are taken apart, both sides a level at a time, until vectors meet
    vectors.
    """
    reach = float(chord(np.array(least_dot)))
    same = a is b
    got_a = [np.zeros(len(c), np.int64) for c in a.center]
    got_b = got_a if same else [np.zeros(len(c), np.int64) for c in b.center]
    edges: list[np.ndarray] = []

    whole_a = [np.zeros(len(c), bool) for c in a.center]
    whole_b = whole_a if same else [np.zeros(len(c), bool) for c in b.center]

    stack = [(0, 0, 0, 0)] if len(a.x) and len(b.x) else []
    while stack:
        at, i, bt, j = stack.pop()
        mine, up_a = (np.arange(a.kids[at][i], a.kids[at][i + 1]), at + 1) if at < a.depth else (np.array([i]), at)
        its, up_b = (np.arange(b.kids[bt][j], b.kids[bt][j + 1]), bt + 1) if bt < b.depth else (np.array([j]), bt)
        for start in range(0, len(mine), 512):
            part = mine[start : start + 512]
            dots = a.x[a.center[up_a][part]] @ b.x[b.center[up_b][its]].T
            if up_a == a.depth and up_b == b.depth:
                hit = dots >= least_dot
                wide = hit
            else:
                far = chord(dots)
                far[part[:, None] == its] = 0 if same and up_a == up_b else far[part[:, None] == its]
                radii = a.radius[up_a][part][:, None] + b.radius[up_b][its]
                wide = far - radii <= reach + ROOM
                hit = far + radii <= reach - ROOM
            if same and at == bt and i == j:
                upper = part[:, None] <= its
                wide, hit = wide & upper, hit & upper
            p, q = np.nonzero(hit)
            if len(p):
                p, q = part[p], its[q]
                twice = p != q if same else np.ones(len(p), bool)
                np.add.at(got_a[up_a], p, b.weight[up_b][q])
                np.add.at(got_b[up_b], q[twice], a.weight[up_a][p[twice]])
                edges.append(np.stack([a.center[up_a][p], b.center[up_b][q]], axis=1)[twice])
                whole_a[up_a][p], whole_b[up_b][q] = True, True
            p, q = np.nonzero(wide & ~hit)
            stack += [(up_a, x, up_b, y) for x, y in zip(part[p].tolist(), its[q].tolist(), strict=True)]
    between = np.concatenate(edges) if edges else np.empty((0, 2), np.int64)
    return Links(_handed_down(a, got_a), _handed_down(b, got_b), between, _to_centers(a, whole_a), _to_centers(b, whole_b))


class Links(NamedTuple):
    """Weights that the vectors of either tree link with, and edges (of two rows) that join all that links."""

    of_a: np.ndarray
    of_b: np.ndarray
    between: np.ndarray
    within_a: np.ndarray
    within_b: np.ndarray


def _to_centers(tree: CoverTree, whole: list[np.ndarray]) -> np.ndarray:
    """Edges from each vector of these nodes to its center: they are joined, as all of them link with another node's."""
    out = [np.empty((0, 2), np.int64)]
    for level, nodes in enumerate(whole[:-1]):
        for i in np.flatnonzero(nodes).tolist():
            rows = tree.order[tree.low[level][i] : tree.high[level][i]]
            out.append(np.stack([rows, np.full(len(rows), tree.center[level][i])], axis=1))
    out = np.concatenate(out)
    return out[out[:, 0] != out[:, 1]]


def _handed_down(tree: CoverTree, got: list[np.ndarray]) -> np.ndarray:
    """What each vector got at its own node and at those above."""
    out = np.zeros(len(tree.x), np.int64)
    for level, part in enumerate(got):
        out[tree.order] += np.repeat(part, tree.high[level] - tree.low[level])
    return out
