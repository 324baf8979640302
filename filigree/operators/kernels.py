"""Array kernels on one graph in compressed rows; no Spark in here."""

from __future__ import annotations

import heapq
from itertools import permutations

import numpy as np


class Csr:
    """Neighbours of dense nodes 0..n-1, sorted; ``w`` are lengths (1.0 where unweighted)."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray | None = None):
        self.ids = np.unique(ids)
        self.n = len(self.ids)
        a, b = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        # One number an arc, so it and its order are all that is held while arcs are sorted.
        arc = np.concatenate([a * self.n + b, b * self.n + a])
        self.degree = np.bincount(a, minlength=self.n) + np.bincount(b, minlength=self.n)
        self.start = np.concatenate([[0], np.cumsum(self.degree)])
        del a, b
        order = np.argsort(arc, kind="stable")
        self.dst = arc[order] % max(1, self.n)
        del arc
        self.w = np.ones(len(order)) if w is None else w[np.where(order < len(w), order, order - len(w))]

    def neighbours(self, i: int) -> np.ndarray:
        return self.dst[self.start[i] : self.start[i + 1]]

    def spread(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, position): all adjacency positions of the nodes, and whose they are."""
        count = self.degree[nodes]
        which = np.repeat(np.arange(len(nodes)), count)
        return which, np.repeat(self.start[nodes] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def hops(g: Csr, sources: np.ndarray) -> np.ndarray:
    """(sources, n) hop distances, inf where unreachable: all sources advance one level at a time."""
    dist = np.full((len(sources), g.n), np.inf)
    flat = dist.reshape(-1)
    row, node, level = np.arange(len(sources)), sources, 0.0
    flat[row * g.n + node] = 0.0
    while len(node):
        level += 1
        which, pos = g.spread(node)
        key = np.unique(row[which] * g.n + g.dst[pos])
        key = key[np.isinf(flat[key])]
        flat[key] = level
        row, node = key // g.n, key % g.n
    return dist


#: Adjacency positions whose rows are gathered at once.
GATHER = 1 << 14


def _bit_sums(rows: np.ndarray) -> np.ndarray:
    """How many rows of words have each bit set: three rows of a place become a sum and a carry until one row a place is left."""
    width = rows.shape[1]
    places, total = [rows], np.zeros(width * 64, np.int64)
    for k in range(64):
        if k == len(places):
            return total
        row, carried = places[k], []
        while len(row) > 1:
            if len(row) % 3:
                row = np.concatenate([row, np.zeros((3 - len(row) % 3, width), np.uint64)])
            third = len(row) // 3
            a, b, c = row[:third], row[third : 2 * third], row[2 * third :]
            half = a ^ b
            carried.append((a & b) | (c & half))
            row = half ^ c
        if carried:
            places.append(np.concatenate(carried))
        if len(row):
            total += np.unpackbits(row.view(np.uint8), axis=1, bitorder="little")[0].astype(np.int64) << k
    return total


def _levels(g: Csr, sources: np.ndarray):
    """Yields (nodes, bits) a level from 1: nodes first reached there, and (nodes, words) by which of the sources."""
    k = np.arange(len(sources))
    front = np.zeros((g.n, -(-len(sources) // 64)), np.uint64)
    np.bitwise_or.at(front, (sources, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    seen, active = front.copy(), np.unique(sources)
    while len(active):
        # Only nodes next to the last level are looked at, and their adjacency is gathered in runs.
        near = np.zeros(g.n, bool)
        near[g.dst[g.spread(active)[1]]] = True
        node = np.flatnonzero(near)
        if not len(node):
            return
        _, pos = g.spread(node)
        begin = np.cumsum(g.degree[node]) - g.degree[node]
        bits = np.empty((len(node), front.shape[1]), np.uint64)
        cuts = np.unique(np.searchsorted(begin, np.arange(0, len(pos) + GATHER, GATHER)))
        for x, y in zip(cuts[:-1], cuts[1:]):
            end = begin[y] if y < len(node) else len(pos)
            bits[x:y] = np.bitwise_or.reduceat(front.take(g.dst[pos[begin[x] : end]], axis=0), begin[x:y] - begin[x], axis=0)
        bits &= ~seen[node]
        new = bits.any(1)
        node, bits = node[new], bits[new]
        front[active] = 0
        front[node] = bits
        seen[node] |= bits
        active = node
        if len(node):
            yield node, bits


def hop_counts(g: Csr, sources: np.ndarray, far: float = np.inf) -> np.ndarray:
    """(sources, levels): nodes first reached from each source at 1, 2, ... hops, fewer than ``far``."""
    counts = []
    for _, new in _levels(g, sources):
        if len(counts) + 1 >= far:
            break
        counts.append(_bit_sums(new)[: len(sources)])
    return np.stack(counts, axis=1) if counts else np.zeros((len(sources), 0), np.int64)


def dijkstra(g: Csr, source: int) -> np.ndarray:
    dist = np.full(g.n, np.inf)
    dist[source] = 0.0
    heap = [(0.0, source)]
    while heap:
        d, i = heapq.heappop(heap)
        if d > dist[i]:
            continue
        for j, w in zip(g.neighbours(i).tolist(), g.w[g.start[i] : g.start[i + 1]].tolist()):
            if d + w < dist[j]:
                dist[j] = d + w
                heapq.heappush(heap, (d + w, j))
    return dist


def carried(known: dict[int, float], fresh: list[int], begin: dict[int, tuple[int, int]], head: list[int], length: list[float], to: list[int], block: int) -> dict[int, tuple[int, float]]:
    """Carries the distances ``known`` of one source on from the ``fresh`` nodes along the arcs that stay in ``block`` (a node's
    are begin[node][0] .. begin[node][1]), changing ``known``; {node: (its block, distance)} of ends in other blocks."""
    heap, told = [(known[i], i) for i in fresh], {}
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if d > known[i] or i not in begin:
            continue
        for k in range(*begin[i]):
            j, e = head[k], d + length[k]
            if to[k] != block:
                if j not in told or e < told[j][1]:
                    told[j] = to[k], e
            elif j not in known or e < known[j]:
                known[j] = e
                heapq.heappush(heap, (e, j))
    return told


def distances(g: Csr, sources: np.ndarray, weighted: bool) -> np.ndarray:
    return np.array([dijkstra(g, int(s)) for s in sources]).reshape(len(sources), g.n) if weighted else hops(g, sources)


def dependencies(g: Csr, sources: np.ndarray, weighted: bool) -> np.ndarray:
    """Sum over the sources of each node's shortest-path dependency (ordered pairs)."""
    if not weighted:
        return _hop_dependencies(g, sources)
    total = np.zeros(g.n)
    tail = np.repeat(np.arange(g.n), g.degree)
    for s in sources:
        dist = dijkstra(g, int(s))
        with np.errstate(invalid="ignore"):
            tight = np.isclose(dist[tail] + g.w, dist[g.dst], rtol=1e-12, atol=0) & np.isfinite(dist[tail])
        a, b = tail[tight], g.dst[tight]
        sigma, delta = np.zeros(g.n), np.zeros(g.n)
        sigma[s] = 1.0
        # Arcs by the distance of their tail; equal distances are independent of each other.
        order = np.argsort(dist[a], kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.diff(dist[a])) + 1
        levels = list(zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(a)]]))) if len(a) else []
        for x, y in levels:
            np.add.at(sigma, b[x:y], sigma[a[x:y]])
        for x, y in reversed(levels):
            np.add.at(delta, a[x:y], sigma[a[x:y]] / sigma[b[x:y]] * (1 + delta[b[x:y]]))
        delta[s] = 0.0
        total += delta
    return total


def hop_levels(g: Csr, sources: np.ndarray) -> np.ndarray:
    """(sources, n) hop distances as whole numbers, -1 where unreachable."""
    out = np.full((len(sources), g.n), -1, np.int32)
    out[np.arange(len(sources)), sources] = 0
    for k, (node, new) in enumerate(_levels(g, sources), 1):
        at, source = np.nonzero(np.unpackbits(new.view(np.uint8), axis=1, bitorder="little"))
        out[source, node[at]] = k
    return out


def _hop_dependencies(g: Csr, sources: np.ndarray) -> np.ndarray:
    """dependencies by hops: only arcs from one level to the next count, in order of their level."""
    total = np.zeros(g.n)
    tail = np.repeat(np.arange(g.n), g.degree)
    u, v = tail[tail < g.dst], g.dst[tail < g.dst]
    for s, level in zip(sources, hop_levels(g, sources)):
        step = level[v] - level[u]
        up, down = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        a, b = np.concatenate([u[up], v[down]]), np.concatenate([v[up], u[down]])
        of, last = level[a], int(level.max())
        # Numbers of two bytes are sorted by counting.
        order = np.argsort(of.astype(np.int16) if last < 1 << 15 else of, kind="stable")
        a, b = a[order], b[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=last))])
        sigma, delta = np.zeros(g.n), np.zeros(g.n)
        sigma[s] = 1.0
        for x, y in zip(cuts[:-1], cuts[1:]):
            np.add.at(sigma, b[x:y], sigma[a[x:y]])
        for x, y in zip(cuts[-2::-1], cuts[:0:-1]):
            np.add.at(delta, a[x:y], sigma[a[x:y]] / sigma[b[x:y]] * (1 + delta[b[x:y]]))
        delta[s] = 0.0
        total += delta
    return total


def transport(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> float:
    """Exact least cost of moving mass p to q: successive shortest augmenting paths."""
    p, q = p.astype(float).copy(), q.astype(float).copy()
    m, n = cost.shape
    flow = np.zeros((m, n))
    eps = 1e-13
    # Entries, not sums: many that rounding left below eps are nothing that could be moved.
    while (p > eps).any() and (q > eps).any():
        # Bellman-Ford over rows and columns of the residual graph.
        du, dv = np.where(p > eps, 0.0, np.inf), np.full(n, np.inf)
        back_v, back_u = np.full(n, -1), np.full(m, -1)
        for _ in range(m + n):
            forth = du[:, None] + cost
            best = forth.argmin(0)
            better = forth[best, np.arange(n)] < dv - eps
            dv[better], back_v[better] = forth[best, np.arange(n)][better], best[better]
            back = np.where(flow > eps, dv[None, :] - cost, np.inf)
            best = back.argmin(1)
            better_u = back[np.arange(m), best] < du - eps
            du[better_u], back_u[better_u] = back[np.arange(m), best][better_u], best[better_u]
            if not better.any() and not better_u.any():
                break
        j = int(np.where(q > eps, dv, np.inf).argmin())
        path, amount, end = [], q[j], j
        while True:
            i = int(back_v[j])
            path.append((i, j, 1))
            if back_u[i] < 0:
                amount = min(amount, p[i])
                break
            j = int(back_u[i])
            path.append((i, j, -1))
            amount = min(amount, flow[i, j])
        for i, j, sign in path:
            flow[i, j] += sign * amount
        p[path[-1][0]] -= amount
        q[end] -= amount
    return float((flow * cost).sum())


def transport_by_force(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> float:
    """Least cost between small integer masses, over all assignments (for tests)."""
    a = [i for i, k in enumerate(p) for _ in range(int(k))]
    b = [j for j, k in enumerate(q) for _ in range(int(k))]
    return min(sum(cost[i, j] for i, j in zip(a, x)) for x in set(permutations(b)))


def masses(g: Csr, i: int, alpha: float, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, masses) of a node's lazy neighbourhood measure: alpha stays, the rest on neighbours."""
    near = g.neighbours(i)
    if not len(near):
        return np.array([i]), np.array([1.0])
    if weighted:
        e = -g.w[g.start[i] : g.start[i + 1]] ** 2
        share = np.exp(e - e.max())
        share = (1 - alpha) * share / share.sum()
    else:
        share = np.full(len(near), (1 - alpha) / len(near))
    return np.append(near, i), np.append(share, alpha)


def curvature(g: Csr, i: int, j: int, length: float, dist: dict[int, np.ndarray | WithinThree], alpha: float, weighted: bool) -> float:
    """1 - W1 / d over an edge; 0 for an edge of length 0."""
    if length == 0:
        return 0.0
    a, p = masses(g, i, alpha, weighted)
    b, q = masses(g, j, alpha, weighted)
    return 1.0 - moved(a, p, b, q, lambda x, y: np.array([dist[int(k)][y] for k in x])) / length


def moved(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, cost) -> float:
    """Least cost of moving masses p on nodes a to q on nodes b; cost(x, y) is a matrix of distances.

    Distances obey the triangle inequality, so mass that both have on a node stays there.
    """
    p, q = p.copy(), q.copy()
    _, i, j = np.intersect1d(a, b, return_indices=True)
    both = np.minimum(p[i], q[j])
    p[i] -= both
    q[j] -= both
    x, y = p > 1e-15, q > 1e-15
    return transport(p[x], q[y], cost(a[x], b[y])) if x.any() and y.any() else 0.0


class WithinThree:
    """Hops from a node to an array of others as if none were farther than 3; holds what lies within two hops alone."""

    def __init__(self, g: Csr, i: int):
        near = g.neighbours(i)
        ids = np.concatenate([[i], near, g.dst[g.spread(near)[1]]])
        # Of equal ids the first is kept, so the least hops.
        self.ids, first = np.unique(ids, return_index=True)
        self.hops = np.where(first == 0, 0.0, np.where(first <= len(near), 1.0, 2.0))

    def __getitem__(self, others: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, others), len(self.ids) - 1)
        return np.where(self.ids[at] == others, self.hops[at], 3.0)


def near_distances(a: list[np.ndarray], b: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hop distances between neighbours x of one end of an edge and y of its other end, from their sorted neighbours
    a and b: 0, 1, 2 with a common neighbour, else the 3 hops over the edge."""
    out = np.full((len(x), len(y)), 3.0)
    for i, near in enumerate(a):
        for j, other in enumerate(b):
            if x[i] == y[j]:
                out[i, j] = 0.0
            elif _has(near, y[j]):
                out[i, j] = 1.0
            elif len(near) and len(other) and np.isin(near, other, assume_unique=True).any():
                out[i, j] = 2.0
    return out


def _has(ids: np.ndarray, k: int) -> bool:
    at = int(np.searchsorted(ids, k))
    return at < len(ids) and ids[at] == k


def principal_vector(g: Csr, weighted: bool, rounds: int = 20_000, tol: float = 1e-11, basis: int = 20, kept: int = 6) -> np.ndarray:
    """Principal eigenvector of a connected graph, absolute, of length one: Lanczos steps, restarted from the best vectors of a full
    basis, until what is left of the equation is below ``tol`` of the distance to the next value (or what rounding leaves)."""
    w = g.w if weighted else np.ones(len(g.dst))
    tail = np.repeat(np.arange(g.n), g.degree)
    v, image = np.empty((basis, g.n)), np.empty((basis, g.n))
    new, k = np.full(g.n, 1 / np.sqrt(max(1, g.n))), 0
    for _ in range(rounds):
        before = np.linalg.norm(new)
        for _ in range(2):
            new = new - (v[:k] @ new) @ v[:k]
        length = np.linalg.norm(new)
        # What lies in the basis adds nothing: its best vector is the answer.
        done = length <= 1e-13 * before
        if not done:
            v[k] = new / length
            image[k] = np.bincount(tail, w * v[k][g.dst], minlength=g.n)
            k += 1
        if k < basis and not done:
            new = image[k - 1]
            continue
        small = v[:k] @ image[:k].T
        value, vector = np.linalg.eigh((small + small.T) / 2)
        best = vector[:, ::-1][:, :kept].T
        v[: len(best)], image[: len(best)] = best @ v[:k], best @ image[:k]
        k = len(best)
        new = image[0] - value[-1] * v[0]
        gap = value[-1] - value[-2] if len(value) > 1 else np.inf
        if done or np.linalg.norm(new) <= max(tol * gap, 2e-14 * abs(value[-1])):
            return np.abs(v[0])
    raise RuntimeError(f"principal vector not settled after {rounds} rounds")


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, label): the ends of the edges, ascending, and the smallest id that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return ids, ids[label]
        # Roots hook under smaller ones; then every id goes up to its root.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trimmed(ids: np.ndarray, u: np.ndarray, v: np.ndarray, target: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(inside, kept): rows of the nodes (ascending ids) and edges left when the average degree is within slack * target.

    A round keeps the edges with the least larger end degree, ties by (u, v), then the largest component, ties to the smallest id.
    """
    inside, kept = np.ones(len(ids), bool), np.arange(len(u))
    while len(kept) and 2 * len(kept) / inside.sum() > slack * target:
        a, b = np.searchsorted(ids, u[kept]), np.searchsorted(ids, v[kept])
        degree = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        kept = kept[np.lexsort((v[kept], u[kept], np.maximum(degree[a], degree[b])))[: int(slack * target * inside.sum() / 2)]]
        label = np.arange(len(ids))
        ends, least = smallest_reachable(u[kept], v[kept])
        label[np.searchsorted(ids, ends)] = np.searchsorted(ids, least)
        inside &= label == np.bincount(label[inside]).argmax()
        kept = kept[inside[np.searchsorted(ids, u[kept])]]
    return inside, np.sort(kept)
