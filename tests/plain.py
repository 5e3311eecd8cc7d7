"""Plain versions of iterative operators, on dense arrays and dictionaries."""

import hashlib
import math

import numpy as np


def naive_linkage(d, method):
    """Heights and member sets of the merges, the nearest pair first."""
    d = {frozenset(k): v for k, v in d.items()}
    size = {i: 1 for k in d for i in k}
    members = {i: {i} for i in size}
    out = []
    while len(size) > 1:
        pair = min(d, key=lambda k: (d[k], min(k), max(k)))
        a, b = min(pair), max(pair)
        height = d.pop(pair)
        for c in [c for c in size if c not in pair]:
            x, y = d.pop(frozenset((a, c))), d.pop(frozenset((b, c)))
            na, nb, nc = size[a], size[b], size[c]
            d[frozenset((a, c))] = {
                "single": min(x, y),
                "complete": max(x, y),
                "average": (na * x + nb * y) / (na + nb),
                "weighted": (x + y) / 2,
                "ward": math.sqrt(max(0, ((na + nc) * x * x + (nb + nc) * y * y - nc * height * height) / (na + nb + nc))),
            }[method]
        size[a] += size.pop(b)
        members[a] |= members.pop(b)
        out.append((height, frozenset(members[a])))
    return sorted(out, key=lambda r: (r[0], len(r[1])))


def plain_nndsvd(x, k):
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((x.shape[0], k)), np.zeros((k, x.shape[1]))
    for i in range(k):
        a, b = u[:, i], vt[i]
        if i == 0:
            w[:, 0], h[0] = np.sqrt(s[0]) * np.abs(a), np.sqrt(s[0]) * np.abs(b)
            continue
        options = [(np.clip(sign * a, 0, None), np.clip(sign * b, 0, None)) for sign in (1, -1)]
        a, b = max(options, key=lambda o: np.linalg.norm(o[0]) * np.linalg.norm(o[1]))
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        w[:, i], h[i] = np.sqrt(s[i] * na * nb) * a / na, np.sqrt(s[i] * na * nb) * b / nb
    w[w < 1e-6], h[h < 1e-6] = 0, 0
    return w, h


def plain_gnmf(x, a, w, h, lambd, rounds, e=2.2e-16):
    degrees = np.diag(a.sum(0))
    for _ in range(rounds):
        h = h * (lambd * h @ a + w.T @ ((x + e) / (w @ h + e)) + e) / (lambd * h @ degrees + w.T @ np.ones(x.shape) + e)
        h[h <= 0] = e
        w = w * (((x + e) / (w @ h + e)) @ h.T + e) / (np.ones(x.shape) @ h.T + e)
        w[w <= 0] = e
    return w, h


def sampled(ids, replicate, seed, frac=0.8):
    """The ids of a replicate: the first share by md5 of seed:replicate:id."""
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{replicate}:{i}".encode()).hexdigest(), i))
    return sorted(order[: int(frac * len(ids))])


def plain_replicate(cells, weights, people, genes, replicate, k, lambd, rounds, seed=42):
    """Labels of one replicate of {(individual, gene): value} over {(gene, gene): weight}."""
    rows, columns = sampled(people, replicate, seed), sampled(genes, replicate, seed + 1)
    x = np.array([[cells.get((i, g), 0.0) for g in columns] for i in rows])
    a = np.array([[weights.get((g, o), 0.0) for o in columns] for g in columns])
    w, h = plain_gnmf(x, a, *plain_nndsvd(x, k), lambd, rounds)
    margin = lambda f: np.sort(f, axis=1)[:, -1] - np.sort(f, axis=1)[:, -2] > 1e-9 * np.abs(f).max()
    out = {}
    for side, ids, f in (("individual", rows, w), ("gene", columns, h.T)):
        for i, label, clear in zip(ids, f.argmax(axis=1), margin(f), strict=True):
            if clear:  # ties in the last bits may go either way
                out[side, i] = int(label)
    return out


def modularity(edges, found):
    """Of a 0/1 network of (a, b), both directions, and {gene: community}."""
    degree = {}
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    m2, totals = len(edges), {}
    for g, d in degree.items():
        totals[found[g]] = totals.get(found[g], 0) + d
    inner = sum(found[a] == found[b] for a, b in edges)
    return inner / m2 - sum(t * t for t in totals.values()) / m2**2
