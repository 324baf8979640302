"""Growing random networks that follow measured statistics: one candidate is one task's work.

Placement is sequential by nature (each node depends on all before it), so the
inside is a plain-Python kernel over a uniform grid; Spark spreads candidates
and tiles.  Seeds are ``seed + candidate``, so reruns agree.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

#: A grown network must have more nodes than this.
LEAST_NODES = 100
FRAME_SLACK = 1.1
REGROWTHS = 100
#: Lengths and angles of a degree that growth draws from; of more, so many of their quantiles.
MOST_VALUES = 4096


@dataclass(frozen=True)
class Counted:
    """A sorted list that holds each of its distinct values once, with how many of the list are no greater."""

    values: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, i: int) -> float:
        return float(self.values[np.searchsorted(self.ends, i, "right")])


@dataclass(frozen=True)
class Sample:
    """What growth draws from: plain lists or counted ones, so that it travels in closures."""

    degrees: dict[int, float]
    transitions: dict[int, dict[int, float]]
    lengths: dict[int, list[float] | Counted]
    angles: dict[int, list[float] | Counted]
    average_length: float
    average_degree: float

    @classmethod
    def of_row(cls, row) -> Sample:
        drawn = [{k: Counted(np.array(v["values"]), np.array(v["ends"])) if hasattr(v, "asDict") else v for k, v in (row[c] or {}).items()} for c in ("degree_lengths", "degree_angles")]
        return cls(row["degree_distribution"] or {}, row["degree_transition_probs"] or {}, *drawn, row["average_length"], row["average_degree"])


@dataclass(frozen=True)
class Params:
    node_factor: float = 1.0
    edge_factor: float = 1.0
    width: float = 256.0
    height: float = 256.0
    seed: int | None = None

    def rng(self, worker: int = 0) -> np.random.Generator:
        return np.random.default_rng(None if self.seed is None else self.seed + worker)


@dataclass
class Node:
    id: int
    x: float
    y: float
    degree: int
    base: float
    clockwise: bool
    parent: int = -1
    children: list[int] = field(default_factory=list)


def _draw(rng: np.random.Generator, shares: dict[int, float]) -> int:
    keys = sorted(shares)
    total = np.cumsum([shares[k] for k in keys])
    return int(keys[min(len(keys) - 1, int(np.searchsorted(total, rng.random() * total[-1], "right")))])


def _pick(rng: np.random.Generator, values: list[float] | Counted) -> float:
    return float(values[int(rng.integers(len(values)))])


def meets(ax, ay, bx, by, cx, cy, dx, dy) -> bool:
    """Do the segments ab and cd meet?"""
    side = lambda x1, y1, x2, y2, x, y: (lambda v: int(v > 0) - int(v < 0))((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))
    on = lambda x1, y1, x2, y2, x, y: min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
    a, b = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    c, d = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    if a != b and c != d:
        return True
    return (not a and on(ax, ay, bx, by, cx, cy)) or (not b and on(ax, ay, bx, by, dx, dy)) or (not c and on(cx, cy, dx, dy, ax, ay)) or (not d and on(cx, cy, dx, dy, bx, by))


class Plane:
    """Placed nodes and edges on a uniform grid of mean-edge-length cells."""

    def __init__(self, sample: Sample, params: Params, rng: np.random.Generator):
        self.s, self.p, self.rng = sample, params, rng
        self.size = sample.average_length or 1.0
        self.near_node = (self.size * params.node_factor) ** 2
        self.near_edge = (self.size * params.edge_factor) ** 2
        self.reach_node, self.reach_edge = math.ceil(params.node_factor), math.ceil(params.edge_factor)
        self.nodes: list[Node] = []
        self.edges: list[tuple[int, int]] = []
        self._joined: set[tuple[int, int]] = set()
        self._cells: dict[tuple[int, int], list[int]] = {}
        self._edge_cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._end_cells: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.merged = self.aborted = 0

    def cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.size), math.floor(y / self.size)

    def add(self, x: float, y: float, degree: int, base: float, clockwise: bool, parent: int = -1) -> Node:
        node = Node(len(self.nodes), x, y, degree, base, clockwise, parent)
        self.nodes.append(node)
        self._cells.setdefault(self.cell(x, y), []).append(node.id)
        return node

    def join(self, a: int, b: int) -> None:
        key = (min(a, b), max(a, b))
        if a == b or key in self._joined:
            return
        self._joined.add(key)
        self.edges.append(key)
        p, q = self.nodes[a], self.nodes[b]
        (i0, j0), (i1, j1) = self.cell(min(p.x, q.x), min(p.y, q.y)), self.cell(max(p.x, q.x), max(p.y, q.y))
        for i in range(i0, i1 + 1):
            for j in range(j0, j1 + 1):
                self._edge_cells.setdefault((i, j), []).append(key)
        for n in (p, q):
            self._end_cells.setdefault(self.cell(n.x, n.y), []).append((*key, n.id))

    def _around(self, table: dict, x: float, y: float, reach: int):
        i, j = self.cell(x, y)
        for di in range(-reach, reach + 1):
            for dj in range(-reach, reach + 1):
                yield from table.get((i + di, j + dj), ())

    def closest(self, x: float, y: float, own: Node) -> int | None:
        """The nearest placed node under the threshold, ties to the smaller id; not the node or its children."""
        best = None
        for k in self._around(self._cells, x, y, self.reach_node):
            n = self.nodes[k]
            d = (n.x - x) ** 2 + (n.y - y) ** 2
            if d < self.near_node and k != own.id and k not in own.children and (best is None or (d, k) < best):
                best = (d, k)
        return None if best is None else best[1]

    def crowded(self, x: float, y: float, own: Node) -> bool:
        """Is an end of an edge too near? Edges at the node or its parent are exempt, if it has a parent."""
        spared = {own.id, own.parent} if own.parent >= 0 else set()
        for a, b, end in self._around(self._end_cells, x, y, self.reach_edge):
            if a in spared or b in spared:
                continue
            n = self.nodes[end]
            if (n.x - x) ** 2 + (n.y - y) ** 2 < self.near_edge:
                return True
        return False

    def crosses(self, a: int, x: float, y: float, b: int = -1) -> bool:
        """Does the segment from node a to (x, y) meet an edge? Edges at a, and at b if that is the node there, are exempt."""
        p = self.nodes[a]
        (i0, j0), (i1, j1) = self.cell(min(p.x, x), min(p.y, y)), self.cell(max(p.x, x), max(p.y, y))
        seen = set()
        for i in range(i0, i1 + 1):
            for j in range(j0, j1 + 1):
                for e in self._edge_cells.get((i, j), ()):
                    if e in seen or a in e or b in e:
                        continue
                    seen.add(e)
                    q, r = self.nodes[e[0]], self.nodes[e[1]]
                    if meets(p.x, p.y, x, y, q.x, q.y, r.x, r.y):
                        return True
        return False

    def root(self) -> Node:
        """A first node at the origin with one child in a random direction."""
        node = self.add(0.0, 0.0, _draw(self.rng, self.s.degrees), float(self.rng.random() * 360), bool(self.rng.random() < 0.5))
        self._child(node, node.base)
        return node

    def _child(self, node: Node, angle: float) -> Node | None:
        """Merge with a near node or place a new child; give up beside an edge, and where the new edge would cross one."""
        r = _pick(self.rng, self.s.lengths.get(node.degree) or [self.size])
        x, y = node.x + r * math.cos(math.radians(angle)), node.y + r * math.sin(math.radians(angle))
        near = self.closest(x, y, node)
        if near is not None:
            if self.crosses(node.id, self.nodes[near].x, self.nodes[near].y, near):
                self.aborted += 1
                return None
            self.join(node.id, near)
            node.children.append(near)
            self.merged += 1
            return self.nodes[near]
        if self.crowded(x, y, node) or self.crosses(node.id, x, y):
            self.aborted += 1
            return None
        degree = _draw(self.rng, self.s.transitions.get(node.degree) or self.s.degrees)
        child = self.add(x, y, degree, (angle + 180) % 360, bool(self.rng.random() < 0.5), node.id)
        child.children.append(node.id)
        node.children.append(child.id)
        self.join(node.id, child.id)
        return child

    def branch(self, node: Node) -> list[Node]:
        """The node's missing children, at accumulated gaps from its base direction."""
        made, angle = [], node.base
        gaps = self.s.angles.get(node.degree)
        for _ in range(max(0, node.degree - len(node.children))):
            gap = _pick(self.rng, gaps) if gaps else 360.0 / max(1, node.degree)
            angle += -gap if node.clockwise else gap
            child = self._child(node, angle % 360)
            if child is not None:
                made.append(child)
        return made

    def grow(self, width: float, height: float, on_round=None) -> None:
        """Breadth first within the frame about the origin; ``on_round(round, plane)`` may stop it with False."""
        inside = lambda n: abs(n.x) <= width / 2 and abs(n.y) <= height / 2
        first = self.root()
        queue, turn = deque([first, *(self.nodes[c] for c in first.children)]), 0
        done: set[int] = set()
        while queue:
            turn += 1
            for _ in range(len(queue)):
                node = queue.popleft()
                if node.id in done or not inside(node):
                    continue
                done.add(node.id)
                queue.extend(self.branch(node))
            if on_round is not None and on_round(turn, self) is False:
                return


Network = tuple[np.ndarray, np.ndarray]


def largest(xy: np.ndarray, edges: np.ndarray) -> Network:
    """The largest component (ties: the one with the first node), renumbered."""
    label = np.arange(len(xy))
    while len(edges):
        low = np.minimum(label[edges[:, 0]], label[edges[:, 1]])
        new = label.copy()
        np.minimum.at(new, edges[:, 0], low)
        np.minimum.at(new, edges[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    if not len(xy):
        return xy, edges
    return subset(xy, edges, label == np.bincount(label).argmax())


def subset(xy: np.ndarray, edges: np.ndarray, keep: np.ndarray) -> Network:
    new = np.cumsum(keep) - 1
    e = edges[keep[edges[:, 0]] & keep[edges[:, 1]]] if len(edges) else edges
    return xy[keep], new[e] if len(e) else np.zeros((0, 2), int)


def cropped(xy: np.ndarray, edges: np.ndarray, width: float, height: float) -> Network:
    """Nodes in the frame about the mean position, then the largest component."""
    if not len(xy):
        return xy, edges
    c = np.abs(xy - xy.mean(0))
    return largest(*subset(xy, edges, (c[:, 0] <= width / 2) & (c[:, 1] <= height / 2)))


def arrays(plane: Plane) -> Network:
    return np.array([(n.x, n.y) for n in plane.nodes], float).reshape(-1, 2), np.array(plane.edges, int).reshape(-1, 2)


def network(sample: Sample, params: Params, worker: int = 0, on_round=None, rng: np.random.Generator | None = None) -> tuple[Network, dict[str, int]]:
    """A network of more than LEAST_NODES nodes if REGROWTHS tries give one; and its counters."""
    rng = params.rng(worker) if rng is None else rng
    best, tries, plane = (np.zeros((0, 2)), np.zeros((0, 2), int)), 0, None
    for tries in range(1, REGROWTHS + 1):
        plane = Plane(sample, params, rng)
        plane.grow(round(params.width * FRAME_SLACK), round(params.height * FRAME_SLACK), on_round)
        best = arrays(plane)
        if len(best[0]) > LEAST_NODES:
            break
    out = cropped(*largest(*best), params.width, params.height)
    return out, {"tries": tries, "merged": plane.merged, "aborted": plane.aborted}


def early_network(sample: Sample, params: Params, rng: np.random.Generator, until: int, every: int = 1) -> tuple[Network, dict]:
    """The largest component once a growing network has ``until`` nodes, looked at every ``every`` rounds; ``reached`` says whether it had."""
    reached, plane, tries = [], None, 0

    def look(turn: int, plane: Plane) -> bool | None:
        if turn % every == 0 and len(plane.nodes) >= until:
            reached.append(turn)
            return False
        return None

    for tries in range(1, REGROWTHS + 1):
        plane = Plane(sample, params, rng)
        plane.grow(round(params.width * FRAME_SLACK), round(params.height * FRAME_SLACK), look)
        if reached or len(plane.nodes) > LEAST_NODES:
            break
    return largest(*arrays(plane)), {"tries": tries, "merged": plane.merged, "aborted": plane.aborted, "reached": bool(reached)}


@dataclass(frozen=True)
class Tile:
    """A grown tile: interior network, and the frontier that phase two goes on from."""

    xy: np.ndarray
    edges: np.ndarray
    #: x, y, degree, base angle, clockwise, parent row
    frontier: list[tuple[float, float, int, float, bool, int]]


def tile(sample: Sample, params: Params, worker: int, rng: np.random.Generator | None = None) -> Tile:
    """One tile; frontier: outside the frame, degree over one, at most one child."""
    plane = Plane(sample, params, params.rng(worker) if rng is None else rng)
    plane.grow(params.width, params.height)
    front = [n for n in plane.nodes if (abs(n.x) > params.width / 2 or abs(n.y) > params.height / 2) and n.degree > 1 and len(n.children) <= 1 and n.parent >= 0]
    gone = {n.id for n in front}
    keep = np.array([n.id not in gone for n in plane.nodes], bool)
    new = np.cumsum(keep) - 1
    xy, edges = subset(*arrays(plane), keep)
    return Tile(xy, edges, [(n.x, n.y, n.degree, n.base, n.clockwise, int(new[n.parent])) for n in front if keep[n.parent]])


def stitch(sample: Sample, params: Params, tiles: list[tuple[float, float, Tile]], most_rounds: int, on_round=None) -> tuple[Network, int]:
    """Phase two: the tiles at their centres on one plane, then growth from a randomly popped
    frontier until it dies out or ``most_rounds`` virtual rounds (as many pops as the frontier held) pass."""
    rng = params.rng()
    plane = Plane(sample, params, rng)
    frontier: list[int] = []
    for cx, cy, t in tiles:
        base = len(plane.nodes)
        for x, y in t.xy:
            plane.add(float(x) + cx, float(y) + cy, 1, 0.0, False)
        for a, b in t.edges:
            plane.join(base + int(a), base + int(b))
        for x, y, degree, angle, clockwise, parent in t.frontier:
            node = plane.add(x + cx, y + cy, degree, angle, clockwise, base + parent)
            node.children.append(base + parent)
            plane.join(node.id, base + parent)
            frontier.append(node.id)
    inside = lambda n: abs(n.x) <= params.width / 2 and abs(n.y) <= params.height / 2
    done: set[int] = set()
    turn = 0
    while frontier and turn < most_rounds:
        turn += 1
        for _ in range(len(frontier)):
            if not frontier:
                break
            k = int(rng.integers(len(frontier)))
            frontier[k], frontier[-1] = frontier[-1], frontier[k]
            node = plane.nodes[frontier.pop()]
            if node.id in done or not inside(node):
                continue
            done.add(node.id)
            frontier += [c.id for c in plane.branch(node) if c.id not in done]
        if on_round is not None and on_round(turn, plane) is False:
            break
    xy, edges = arrays(plane)
    keep = np.array([inside(n) for n in plane.nodes], bool)
    return largest(*subset(xy, edges, keep)) if len(xy) else (xy, edges), turn


def snapshot_rounds(every: int, most_rounds: int) -> list[int]:
    """Every k-th round up to the last; for a negative k rounds that grow by the -k-th root of ``most_rounds``
    (twofold for one), cut to whole numbers and by one at least."""
    if every > 0:
        return list(range(every, most_rounds + 1, every))
    out, at = [], 1
    factor = most_rounds ** (1.0 / -every) if every < -1 else 2.0
    while every and at <= most_rounds:
        out.append(at)
        at = max(at + 1, int(at * factor))
    return out


def centres(width: float, height: float, spacing: float, most: int, rng: np.random.Generator, patience: int = 50_000) -> np.ndarray:
    """Random centres at least ``spacing`` apart; stops at ``most`` or after ``patience`` rejects in a row."""
    out: list[tuple[float, float]] = []
    cells: dict[tuple[int, int], list[int]] = {}
    size, rejected = max(spacing, 1e-12), 0
    while len(out) < most and rejected < patience:
        x, y = rng.random() * width, rng.random() * height
        i, j = math.floor(x / size), math.floor(y / size)
        near = (k for a in (-1, 0, 1) for b in (-1, 0, 1) for k in cells.get((i + a, j + b), ()))
        if any((out[k][0] - x) ** 2 + (out[k][1] - y) ** 2 < spacing**2 for k in near):
            rejected += 1
            continue
        cells.setdefault((i, j), []).append(len(out))
        out.append((x, y))
        rejected = 0
    return np.array(out).reshape(-1, 2)
