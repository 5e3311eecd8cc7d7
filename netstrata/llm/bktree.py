"""BK-trees over bit fingerprints, many at once.

A BK-tree keeps a fingerprint in each node; the children of a node are keyed by their integer Hamming distance to it.
A search with a radius follows only edges within distance +- radius. Here the trees of many shards form one forest held
in numpy arrays, built and searched a level at a time for all items together.
"""

from __future__ import annotations

import numpy as np


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of two (n, words) arrays of unsigned 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One tree for each run of equal values in shard (sorted)."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        self.prints, self.span = prints, 64 * prints.shape[1] + 1
        first = np.r_[True, shard[1:] != shard[:-1]] if len(shard) else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if len(shard) else np.zeros(0, np.int64)
        waiting = np.flatnonzero(~first)
        at = self.root[waiting]
        edges, nodes = [], []
        while len(waiting):
            key = at * self.span + hamming(prints[waiting], prints[at])
            edge, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[where]  # the first to come with an edge becomes its node
            edges.append(edge)
            nodes.append(child)
            stays = np.ones(len(waiting), bool)
            stays[where] = False
            at, waiting = child[inverse][stays], waiting[stays]
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(self.edge)
        self.edge, self.node = self.edge[order], self.node[order]

    def search(self, queries: np.ndarray, radius: np.ndarray | int, linked=None):
        """Yield (query, node, distance) arrays of hits for items of the forest; radius may differ by query."""
        radius = np.broadcast_to(np.asarray(radius, np.int64), queries.shape)
        query, node = np.arange(len(queries)), self.root[queries]
        while len(query):
            distance = hamming(self.prints[queries[query]], self.prints[node])
            reach = radius[query]
            hit = (distance <= reach) & (queries[query] != node)
            yield queries[query[hit]], node[hit], distance[hit]
            base = node * self.span
            low = np.searchsorted(self.edge, base + np.maximum(distance - reach, 0))
            high = np.searchsorted(self.edge, base + np.minimum(distance + reach, self.span - 1), side="right")
            count = high - low
            total = int(count.sum())
            node = self.node[np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)]
            query = np.repeat(query, count)


def smallest_linked(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (indices of smaller or equal items), changed in place, after joining the components of each a and b."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped
    return labels


def join(labels: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray, accept=None) -> None:
    """Join, in labels, the components of each a and b that accept lets stand; pairs that others have joined aren't asked.

    A round asks about the first few pairs of each component, twice as many each time: near copies need few questions.
    """
    few = 1
    while len(a):
        x, y = labels[a], labels[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        order = apart[np.argsort(x[apart], kind="stable")]
        a, b, distance, x = a[order], b[order], distance[order], x[order]
        first = np.r_[True, x[1:] != x[:-1]]
        asked = np.arange(len(x)) - np.flatnonzero(first)[np.cumsum(first) - 1] < few
        kept = accept(a[asked], b[asked], distance[asked]) if accept is not None else np.ones(int(asked.sum()), bool)
        smallest_linked(labels, a[asked][kept], b[asked][kept])
        a, b, distance, few = a[~asked], b[~asked], distance[~asked], 2 * few


def clustered(prints: np.ndarray, radius: np.ndarray, accept, labels: np.ndarray, rows: np.ndarray, leaders: int = 32) -> np.ndarray:
    """Join, in labels, the items rows of a crowded shard with what is near to some leaders; returns the items still to search.

    A leader takes the items within half of the least radius as its followers. Any other item within its radius is joined
    to the leader; one too far for every follower needs no look at them; only those between are compared with followers.
    So all links of followers are found, and only the items that no leader took remain.
    """
    waiting = rows
    for _ in range(leaders):
        if len(waiting) < 64:
            break
        leader = waiting[0]
        distance = hamming(prints[rows], prints[leader][None, :])
        half = int(radius[rows].min()) // 2
        linked = distance <= radius[rows]
        linked[linked] = accept(np.full(int(linked.sum()), leader), rows[linked], distance[linked])
        taken = linked & (distance <= half) & np.isin(rows, waiting, assume_unique=True)
        smallest_linked(labels, np.full(int(linked.sum()), leader), rows[linked])
        followers = rows[taken]
        between = rows[(distance <= radius[rows].max() + half) & ~linked]
        for at in range(0, len(between), 64):
            for low in range(0, len(followers), 1024):
                own, tile = between[at : at + 64], followers[low : low + 1024]
                own = own[labels[own] != labels[leader]]  # a follower was met: all are linked to the leader
                a, b = np.repeat(own, len(tile)), np.tile(tile, len(own))
                d = hamming(prints[a], prints[b])
                kept = d <= radius[a]
                join(labels, a[kept], b[kept], d[kept], accept)
        waiting = waiting[~np.isin(waiting, followers, assume_unique=True)]
        waiting = waiting[waiting != leader]
        if len(followers) < 16:
            break
    return waiting


def components(shard: np.ndarray, prints: np.ndarray, radius: np.ndarray | int, accept=None, crowded: int = 0, visits: int = 2_000_000) -> np.ndarray:
    """For each item the first item of its component under links within the radius, shard by shard.

    accept(a, b, distance) may turn down links. Shards over ``crowded`` items (0: none) are clustered first. Queries go in
    blocks whose frontiers can't pass ``visits`` fingerprints of one word, or as many bytes of wider ones.
    """
    forest, labels = Forest(shard, prints), np.arange(len(shard))
    if not len(shard):
        return labels
    sizes = np.bincount(forest.root, minlength=len(shard))[forest.root]
    radius = np.broadcast_to(np.asarray(radius, np.int64), shard.shape)
    if crowded and (sizes > crowded).any():
        keep = np.ones(len(shard), bool)
        for root in np.unique(forest.root[sizes > crowded]):
            rows = np.flatnonzero(forest.root == root)
            keep[rows] = np.isin(rows, clustered(prints, radius, accept, labels, rows), assume_unique=True)
        kept = np.flatnonzero(keep)
        inner = components(shard[kept], prints[kept], radius[kept], accept and (lambda a, b, d: accept(kept[a], kept[b], d)), 0, visits)
        return smallest_linked(labels, kept, kept[inner])
    searched = np.flatnonzero(sizes > 1)
    block = np.cumsum(sizes[searched]) // max(1, visits // prints.shape[1])
    for queries in np.split(searched, np.flatnonzero(np.diff(block)) + 1):
        for a, b, distance in forest.search(queries, radius[queries]):
            join(labels, a, b, distance, accept)
    return labels
