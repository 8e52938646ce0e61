"""R-tree over group-count vectors, for joins on the Jaccard similarity of sets.

A set's elements are hashed into groups; its point is the number of elements in each
group. Two sets share at most the sum of the coordinate-wise minima of their points,
and a box shares at most the sum of the minima with its upper corner. A subtree is
left out when that bound is too small for the wanted similarity, or when all that it
holds is already in the asking point's component.
"""

from __future__ import annotations

import numpy as np

FANOUT = 32


class CountRTree:
    """Bulk-loaded by sort-tile-recurse: by set size into slabs, inside by the coordinate that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        m = len(points)
        order = np.argsort(sizes, kind="stable")
        slab = FANOUT * max(1, int(np.sqrt(m / FANOUT)))
        parts = []
        for at in range(0, m, slab):
            part = order[at:at + slab]
            wide = int(np.argmax(points[part].var(axis=0)))
            parts.append(part[np.argsort(points[part, wide], kind="stable")])
        self.order = np.concatenate(parts) if parts else order
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: upper corners, smallest and largest set size
        hi, lo_n, hi_n = self.points, self.sizes, self.sizes
        while len(hi) > 1:
            at = np.arange(0, len(hi), FANOUT)
            hi = np.maximum.reduceat(hi, at, axis=0)
            lo_n, hi_n = np.minimum.reduceat(lo_n, at), np.maximum.reduceat(hi_n, at)
            self.levels.append((hi, lo_n, hi_n))

    def search(self, point, size, p: int, q: int, skip=None) -> np.ndarray:
        """Positions (in tree order) whose bound allows a similarity of p/q to the asking
        set. ``skip(level, nodes)`` masks nodes that need no look."""
        nodes = np.zeros(1, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -2, -1):
            hi, lo_n, hi_n = self.levels[depth] if depth >= 0 else (self.points, self.sizes, self.sizes)
            if depth < len(self.levels) - 1:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(hi)]
            low, high = lo_n[nodes], hi_n[nodes]
            nodes = nodes[(q * high >= p * size) & (q * size >= p * low)]
            if skip is not None and len(nodes):
                nodes = nodes[~skip(depth, nodes)]
            if not len(nodes):
                return nodes
            bound = np.minimum(hi[nodes], point).sum(axis=1, dtype=np.int64)
            nodes = nodes[(p + q) * bound >= p * (size + lo_n[nodes])]
            if not len(nodes):
                return nodes
        return nodes


def spanning_links(points: np.ndarray, sizes: np.ndarray, p: int, q: int, verify=None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the similarity graph of one block.

    Two points link when their bound allows a similarity of p/q and ``verify(i, j)``,
    if given, confirms it. Pairs inside one component found so far are not looked at.
    ``side``: only pairs of different sides count (their own blocks hold the others).
    """
    m = len(points)
    if m < 2:
        return []
    if m == 2:
        if side is not None and side[0] == side[1]:
            return []
        a, b = int(sizes[0]), int(sizes[1])
        if q * min(a, b) < p * max(a, b) or (p + q) * int(np.minimum(points[0], points[1]).sum()) < p * (a + b):
            return []
        return [(0, 1)] if verify is None or verify(0, 1) else []
    tree = CountRTree(points, sizes)
    order = tree.order
    side = None if side is None else side[order]
    label = np.arange(m)
    uniform = [None] * len(tree.levels)  # per level: the one component of a node, or -1

    def refresh():
        lo, hi = label, label
        for d in range(len(tree.levels)):
            at = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            uniform[d] = np.where(lo == hi, lo, -1)

    refresh()
    links = []
    stale = 0
    for i in range(m):

        def skip(depth, nodes, i=i):
            if depth >= 0:
                return uniform[depth][nodes] == label[i]
            out = label[nodes] == label[i]
            return out if side is None else out | (side[nodes] == side[i])

        found = tree.search(tree.points[i], tree.sizes[i], p, q, skip)
        if not len(found):
            continue
        if verify is not None and len(found) > 1:
            found = found[np.argsort(-np.minimum(tree.points[found], tree.points[i]).sum(axis=1), kind="stable")]
        for j in found.tolist():
            if label[j] == label[i]:
                continue
            if verify is None or verify(int(order[i]), int(order[j])):
                links.append((int(order[i]), int(order[j])))
                old = label[j]
                label[label == old] = label[i]
                stale += 1
        if stale:
            stale = 0
            refresh()
    return links
