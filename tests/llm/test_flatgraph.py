"""The flat graph's links against all cosines."""

import numpy as np
import pytest

from filigree.llm import flatgraph

ROWS = "vec_id long, embedding array<double>, label int, id string, cell string, w int"


def beside(r, base, cosine):
    """A unit vector at this cosine from another one."""
    off = r.normal(size=len(base))
    off -= off @ base * base
    return cosine * base + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off)


def planted(seed=1, n=500, dims=32, labels=2, diffuse=60, tight=120):
    """Isolated vectors, pairs just above and below the limit, a tight group and one that is wider than a ball."""
    r = np.random.default_rng(seed)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(r.normal(size=dims))
    out = [unit() for _ in range(n)]
    for c in (0.9, 0.929, 0.9301, 0.935, 0.95, 0.99, 0.9999):
        out += [beside(r, out[r.integers(n)], c) for _ in range(12)]
    centre = unit()
    out += [beside(r, centre, r.uniform(0.99, 0.999)) for _ in range(tight)]
    centre = unit()
    out += [beside(r, centre, r.uniform(0.93, 0.98)) for _ in range(diffuse)]
    return [(int(i), (v * r.uniform(0.1, 9)).tolist(), int(r.integers(labels))) for i, v in zip(r.permutation(len(out)) * 3, out)]


def brute(rows, cosine=flatgraph.COSINE):
    """{id: (links, component)} by all cosines."""
    ids = [r[0] for r in rows]
    label = np.array([r[2] for r in rows])
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= cosine) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    component, out = {}, {}
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        if i not in component:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in component:
                    component[k] = ids[i]
                    todo += np.flatnonzero(link[k]).tolist()
    for i, v in enumerate(ids):
        out[v] = (int(link[i].sum()), component[i])
    return out


def found(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], ROWS).repartition(4)


def test_whole_labels_in_one_shard(spark):
    rows = planted()
    rows += [(10_000 + k, rows[k][1], rows[k][2]) for k in range(40)] + [(20_000 + k, rows[5][1], rows[5][2]) for k in range(30)]
    got = flatgraph.near_duplicates(table(spark, rows)).cache()
    assert found(got) == brute(rows)
    assert got.where("kept <> (vec_id = component_id)").count() == 0 and got.where("audit_recall < 1").count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_split_cells_shards_and_blocks(spark, monkeypatch, seed):
    """Small limits: cells are sampled and split, labels dealt over many shards, members compared in many cells."""
    for name, value in (("SAMPLE", 256), ("SHARD", 200), ("PART", 150), ("CELL", 16)):
        monkeypatch.setattr(flatgraph, name, value)
    rows = planted(seed, n=900)
    got, want = found(flatgraph.near_duplicates(table(spark, rows))), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][0] for i in want) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_what_splitting_does_not_part_meets_in_blocks(spark, monkeypatch):
    for name, value in (("SAMPLE", 64), ("SHARD", 60), ("SPLITS", 1), ("DENSE", 10_000)):
        monkeypatch.setattr(flatgraph, name, value)
    rows = planted(4, n=120, labels=1, tight=30, diffuse=20)
    assert found(flatgraph.near_duplicates(table(spark, rows))) == brute(rows)


def test_defined_cases(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, v, 1), (2, w, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [0.0, 0.0, 0.0], 1)]
    rows += [(10, [1.0, 2.0, float("inf")], 1), (11, [*v, 0.0], 1), (12, [1e200 * x for x in v], 1), (13, [1e-200 * x for x in v], 1), (14, v, 1), (14, v, 1), (15, [-3.0, 1.0, 0.0], 1), (15, [*v], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in flatgraph.near_duplicates(table(spark, rows)).collect())
    five = [(i, 4, 1) for i in (1, 2, 12, 13, 14, 14)]
    alone = [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 15)]
    assert got == sorted(five + alone)
    lost = flatgraph.near_duplicates(spark.createDataFrame([(None, v, 1, "", "", 0), (1, v, 1, "", "", 0)], ROWS)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in lost) == [(0, 0, None, None), (1, 0, 1, True)]
    assert flatgraph.near_duplicates(spark.createDataFrame([], ROWS)).collect() == []


def test_graph_is_pruned_and_reached_from_medoids():
    r = np.random.default_rng(0)
    u = np.concatenate([r.normal(size=(300, 16)), 40 + r.normal(size=(300, 16))])
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = flatgraph.Search()
    graph = flatgraph.shard_graph(u, "x", s)
    assert flatgraph.reached(graph, flatgraph.medoids_of(u, s.medoids)).all()
    first = graph[:, : s.degree]
    for i in range(0, 600, 37):
        near = first[i][first[i] >= 0]
        assert i not in near and len(set(near)) == len(near)
        d = lambda a, b: 2 - 2 * u[a] @ u[b]
        assert all(s.alpha**2 * d(a, b) > d(i, b) for k, a in enumerate(near) for b in near[k + 1 :])


def test_search_visits_part_of_a_shard_and_finds_neighbours():
    r = np.random.default_rng(5)
    u = r.normal(size=(3000, 32))
    u /= np.linalg.norm(u, axis=1)[:, None]
    u = np.concatenate([u, [beside(r, u[k], 0.94) for k in range(200)]])
    s = flatgraph.Search()
    graph, start = flatgraph.shard_graph(u, "y", s), flatgraph.medoids_of(u, s.medoids)
    i, j, c = flatgraph.greedy(u, graph, u[3000:], np.full(200, 0.93), start, s)
    pairs = set(zip(i.tolist(), j.tolist()))
    assert sum((k, k) in pairs for k in range(200)) >= 196 and c.min() >= 0.93


def test_audit_measures_recall(spark):
    rows = planted(6, n=100, labels=1, tight=0, diffuse=0)
    classes = spark.createDataFrame([(r[0], r[2], r[1], 1) for r in rows], "id long, label int, v array<double>, w long")
    base = flatgraph.unit_rows(classes)
    want = brute(rows)
    half = spark.createDataFrame([(i, n if k % 2 else 0) for k, (i, (n, _)) in enumerate(sorted(want.items()))], "id long, n_links long")
    recall, every = flatgraph.audit_recall(base, half, 0.93)
    assert every == sum(n for n, _ in want.values())
    assert recall == pytest.approx(sum(n for k, (i, (n, _)) in enumerate(sorted(want.items())) if k % 2) / every)
