"""Vantage-point trees in numpy: a ball around a point splits rows by their distance to it, and the triangle inequality
tells a query which side can hold what it looks for.

``Tree`` finds the nearest rows of a block of queries. ``Router`` is a tree whose leaves are shards: it names the shard of a
vector and the least distance at which each shard can have a row. ``stretch`` relaxes pruning: a side whose least distance
times the factor passes the reach is left out. At 1 nothing is lost; a larger factor leaves more out. All distances that are
returned are taken in double precision from the differences of the vectors themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LEAF = 48
NONE = np.iinfo(np.int64).max
#: Share of the vectors' lengths by which distances from matrix products may be off; bounds allow for it.
SLACK = 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of a to the same row of b (or to b)."""
    gap = a - b
    return np.sqrt((gap * gap).sum(axis=1))


def rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a, b) distances from matrix products, off by up to SLACK of the lengths."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class _Node:
    vantage: int = -1
    #: least and greatest distance to the vantage point, inside and outside
    ranges: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    sides: tuple[int, int] = (-1, -1)
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Tree:
    """Rows (n, d) with their ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids, self.leaf = vectors, ids, leaf
        self.lengths = (vectors * vectors).sum(axis=1)
        self.nodes: list[_Node] = []
        self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(_Node(rows=rows))
        if len(rows) > self.leaf:
            x = self.vectors[rows]
            corner = int(distances(x, x[0]).argmax())  # a point at the edge parts the rest better than one within
            far = distances(x, x[corner])
            order = np.argsort(far, kind="stable")
            half = len(rows) // 2
            if far[order[-1]] > 0:  # else all are copies
                near, rest = order[:half], order[half:]
                ranges = ((float(far[near[0]]), float(far[near[-1]])), (float(far[rest[0]]), float(far[rest[-1]])))
                node = self.nodes[at] = _Node(int(rows[corner]), ranges)
                node.sides = self._grow(rows[near]), self._grow(rows[rest])
        return at

    def nearest(self, queries: np.ndarray, own: np.ndarray, reach: np.ndarray, k: int, stretch: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), each (queries, k), of the nearest rows within ``reach`` of each query but those with its own id,
        ties to the smaller id; NONE where there are fewer."""
        n = len(queries)
        self.q, self.own, self.k, self.stretch = queries, own, k, stretch
        self.square = (queries * queries).sum(axis=1)
        self.best, self.found, self.reach = np.full((n, k), np.inf), np.full((n, k), NONE), reach.astype(np.float64).copy()
        if len(self.ids):
            self._visit(0, np.arange(n))
        return self.best, self.found

    def _visit(self, at: int, active: np.ndarray) -> None:
        node = self.nodes[at]
        if not len(active):
            return
        if node.vantage < 0:
            self._scan(node.rows, active)
            return
        to = distances(self.q[active], self.vectors[node.vantage])
        least = [np.maximum(0, np.maximum(low - to, to - high)) * self.stretch for low, high in node.ranges]
        inside = least[0] <= least[1]
        for nearer, farther, mine in ((0, 1, inside), (1, 0, ~inside)):
            who = np.flatnonzero(mine)
            self._visit(node.sides[nearer], active[who[least[nearer][who] <= self.reach[active[who]]]])
            self._visit(node.sides[farther], active[who[least[farther][who] <= self.reach[active[who]]]])

    def _scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        x = self.vectors[rows]
        size = self.square[active][:, None] + self.lengths[rows][None, :]
        close = size - 2 * (self.q[active] @ x.T) <= (self.reach[active] ** 2)[:, None] + 1e-9 * size
        close &= self.ids[rows][None, :] != self.own[active][:, None]
        who = np.flatnonzero(close.any(axis=1))
        if not len(who):
            return
        close = close[who]
        i, j = np.nonzero(close)
        exact = np.full(close.shape, np.inf)
        exact[i, j] = distances(self.q[active[who[i]]], x[j])
        exact[exact > self.reach[active[who]][:, None]] = np.inf
        both = np.concatenate([self.best[active[who]], exact], axis=1)
        names = np.concatenate([self.found[active[who]], np.where(np.isfinite(exact), self.ids[rows][None, :], NONE)], axis=1)
        order = np.lexsort((names, both), axis=1)[:, : self.k]
        self.best[active[who]], self.found[active[who]] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        self.reach[active[who]] = np.minimum(self.reach[active[who]], self.best[active[who], -1])


class Router:
    """Shards of the space, from a sample: inner nodes are balls that halve the sample's distinct vectors."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.points: list[np.ndarray] = []
        self.radii: list[float] = []
        self.sides: list[list[int]] = []  # an inner node, or -1 - shard
        self.shards = 0
        sample = np.unique(sample, axis=0) if len(sample) else sample
        self.root = self._grow(sample, max(1, shards))
        self.vantages = np.array(self.points) if self.points else np.zeros((0, 0))

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        if shards < 2 or len(sample) < 2:
            self.shards += 1
            return -self.shards
        point = sample[int(distances(sample, sample[0]).argmax())]
        far = distances(sample, point)
        first = shards // 2
        radius = float(np.sort(far)[max(0, len(far) * first // shards - 1)])
        at = len(self.points)
        self.points.append(point)
        self.radii.append(radius)
        self.sides.append([0, 0])
        self.sides[at] = [self._grow(sample[far <= radius], first), self._grow(sample[far > radius], shards - first)]
        return at

    def _walk(self, vectors: np.ndarray, visit) -> None:
        """visit(shard, which vectors lie in it by their distances, least possible distance of each vector to it)."""
        to = rough(vectors, self.vantages) if len(self.points) else np.zeros((len(vectors), 0))
        slack = SLACK * (1 + np.sqrt((vectors * vectors).sum(axis=1)) + (np.sqrt((self.vantages * self.vantages).sum(axis=1)).max() if len(self.points) else 0))
        stack = [(self.root, np.ones(len(vectors), bool), np.zeros(len(vectors)))]
        while stack:
            at, mine, least = stack.pop()
            if at < 0:
                visit(-at - 1, mine, np.maximum(least - 2 * slack, 0))
                continue
            inside, over = to[:, at] <= self.radii[at], to[:, at] - self.radii[at]
            stack.append((self.sides[at][0], mine & inside, np.maximum(least, over)))
            stack.append((self.sides[at][1], mine & ~inside, np.maximum(least, -over)))

    def shard(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        self._walk(vectors, lambda shard, mine, least: out.__setitem__(mine, shard))
        return out

    def least(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, shards) least distance at which a shard can have a row."""
        out = np.zeros((len(vectors), self.shards))
        self._walk(vectors, lambda shard, mine, least: out.__setitem__((slice(None), shard), least))
        return out
