"""DuckDB SQL for the queries, from the same tables."""

from __future__ import annotations

#: n(id, x, y) and e(u, v, w) of each derived network.
KNN = """
n AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
near AS (SELECT a.vec_id AS u, b.vec_id AS v, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
e AS MATERIALIZED (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v, 1.0::DOUBLE AS w FROM near WHERE r <= 4)"""
LATTICE = """
c AS (SELECT c_custkey AS id FROM customer),
n AS (SELECT id, 10.0::DOUBLE * (id % 40) + 0.1::DOUBLE * ((id * 37) % 11 - 5) AS x, 10.0::DOUBLE * (id // 40) + 0.1::DOUBLE * ((id * 41) % 11 - 5) AS y FROM c),
e AS MATERIALIZED (SELECT u, v, 1.0::DOUBLE AS w FROM (SELECT id AS u, id + 1 AS v FROM c WHERE id % 40 < 39 UNION ALL SELECT id, id + 40 FROM c)
  WHERE (u * v + u * 31 + v * 17) % 97 < 62 AND v IN (SELECT id FROM c))"""
TRADE = """
n AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y FROM nation),
p AS (SELECT least(c_nationkey, s_nationkey)::BIGINT AS u, greatest(c_nationkey, s_nationkey)::BIGINT AS v, count(*)::DOUBLE AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
e AS MATERIALIZED (SELECT * FROM p WHERE w >= (SELECT avg(w) FROM p))"""
SUPPLY = """
e AS MATERIALIZED (SELECT DISTINCT l_partkey * 2 AS u, l_suppkey * 2 + 1 AS v, 1.0::DOUBLE AS w FROM lineitem),
n AS (SELECT DISTINCT unnest([u, v]) AS id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM e)"""
#: Both directions, degrees, placed edges.
BASE = """,
s AS MATERIALIZED (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e),
d AS MATERIALIZED (SELECT n.id, count(s.u) AS deg, coalesce(sum(s.w), 0.0) AS strength FROM n LEFT JOIN s ON s.u = n.id GROUP BY n.id),
pe AS (SELECT s.u, s.v, s.w, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len, degrees(atan2(b.y - a.y, b.x - a.x)) AS ang
  FROM s JOIN n a ON s.u = a.id JOIN n b ON s.v = b.id),
pl AS (SELECT e.u, e.v, e.w, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len, degrees(atan2(b.y - a.y, b.x - a.x)) AS ang
  FROM e JOIN n a ON e.u = a.id JOIN n b ON e.v = b.id),
gaps AS (SELECT u AS node_id, seq, CASE WHEN nxt IS NULL THEN 360.0 + fst - ang ELSE nxt - ang END AS gap FROM (
  SELECT u, ang, row_number() OVER (PARTITION BY u ORDER BY ang, v) AS seq, lead(ang) OVER (PARTITION BY u ORDER BY ang, v) AS nxt, min(ang) OVER (PARTITION BY u) AS fst, count(*) OVER (PARTITION BY u) AS k FROM pe) WHERE k > 1),
tri AS (SELECT ab.u AS a, ab.v AS b, bc.v AS c, ab.w AS wab, bc.w AS wbc, ac.w AS wac FROM e ab JOIN e bc ON ab.v = bc.u JOIN e ac ON ac.u = ab.u AND ac.v = bc.v),
corner AS (SELECT unnest([a, b, c]) AS id, cbrt(wab * wbc * wac) AS g FROM tri),
cl AS (SELECT d.id, CASE WHEN any_value(d.deg) > 1 THEN 2.0 * count(corner.id) / (any_value(d.deg) * (any_value(d.deg) - 1)) ELSE 0.0 END AS c,
  CASE WHEN any_value(d.deg) > 1 THEN 2.0 * coalesce(sum(corner.g), 0.0) / (SELECT max(w) FROM e) / (any_value(d.deg) * (any_value(d.deg) - 1)) ELSE 0.0 END AS o FROM d LEFT JOIN corner ON corner.id = d.id GROUP BY d.id),
met AS (SELECT (SELECT count(*) FROM n) AS node_count, 2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM n) AS avg_degree, (SELECT avg(c) FROM cl) AS avg_clustering, (SELECT avg(len) FROM pl) AS avg_length, (SELECT avg(gap) FROM gaps) AS avg_angle)"""
#: Hop distances, ball histograms on the grid of all radii.
HOPS = """,
hop(src, dst, d) USING KEY (src, dst) AS (SELECT id, id, 0 FROM n UNION SELECT h.src, s.v, min(h.d) + 1 FROM hop h JOIN s ON h.dst = s.u WHERE NOT EXISTS (SELECT 1 FROM recurring.hop r WHERE r.src = h.src AND r.dst = s.v) GROUP BY 1, 2),
ball AS (SELECT src, d AS r, count(*) AS cnt FROM hop WHERE d > 0 GROUP BY 1, 2),
grid AS (SELECT a.src, b.r FROM (SELECT DISTINCT src FROM ball) a, (SELECT DISTINCT r FROM ball) b),
mass AS MATERIALIZED (SELECT g.src, g.r, 1 + sum(coalesce(b.cnt, 0)) OVER (PARTITION BY g.src ORDER BY g.r) AS mass FROM grid g LEFT JOIN ball b ON b.src = g.src AND b.r = g.r),
lnp AS (SELECT r, ln(mass::DOUBLE / max(mass) OVER (PARTITION BY src)) AS p FROM mass),
lnpk AS MATERIALIZED (SELECT r, p, count(*) AS k FROM lnp GROUP BY 1, 2),
band AS (SELECT unnest(range(-10 * {band}, 10 * {band} + 1)) / 10.0 AS q),
z AS (SELECT q, r, sum(k * exp(q * p)) AS z FROM lnpk, band GROUP BY 1, 2),
tau AS MATERIALIZED (SELECT q, regr_slope(ln(z), ln(r::DOUBLE / (SELECT max(r) FROM ball))) AS tau FROM z GROUP BY q),
spec AS (SELECT q, alpha, q * alpha - tau AS f FROM (SELECT q, tau, (lead(tau) OVER (ORDER BY q) - tau) / (lead(q) OVER (ORDER BY q) - q) AS alpha FROM tau) WHERE alpha IS NOT NULL)"""
#: Smallest id reachable (label), over undirected edges.
LABELS = """,
reach(id, label) AS (SELECT id, id FROM n UNION SELECT s.v, r.label FROM reach r JOIN s ON s.u = r.id WHERE r.label < s.v),
lab AS MATERIALIZED (SELECT id, min(label) AS label FROM reach GROUP BY id),
sizes AS (SELECT label, count(*) AS size FROM lab GROUP BY label)"""


def _i(*cols: str) -> str:
    return ", ".join(f"({c.split(' AS ')[0]})::BIGINT AS {c.split(' AS ')[-1].split('.')[-1]}" for c in cols)


def _f(*cols: str) -> str:
    return ", ".join(f"round(({c.split(' AS ')[0]})::DOUBLE, 6) + 0.0 AS {c.split(' AS ')[-1].split('.')[-1]}" for c in cols)


def _q(net: str, select: str, extra: str = "", band: int = 3) -> str:
    return f"WITH RECURSIVE {net}{BASE}{extra.replace('{band}', str(band))} SELECT {select}"


_DEG_PAIRS = "SELECT a.deg AS degree_u, b.deg AS degree_v, count(*) AS n FROM s JOIN d a ON s.u = a.id JOIN d b ON s.v = b.id GROUP BY 1, 2"
_TRANS = f"{_i('degree_u', 'degree_v', 'n')}, {_f('n / sum(n) OVER (PARTITION BY degree_u) AS prob')} FROM ({_DEG_PAIRS})"
_TRIALS = "(SELECT (o_orderkey % 18) / 10.0 + 0.3 AS node_factor, ((o_orderkey // 18) % 18) / 10.0 + 0.3 AS edge_factor, round(o_totalprice / 1000, 0) AS error, round((o_custkey % 50) / 50.0, 2)::DOUBLE AS success_rate, o_orderkey FROM orders)"
_SCORE = f"(SELECT *, 0.5 * (1 - (error - min(error) OVER ()) / (max(error) OVER () - min(error) OVER ())) + 0.5 * (success_rate - min(success_rate) OVER ()) / (max(success_rate) OVER () - min(success_rate) OVER ()) AS score FROM {_TRIALS} WHERE success_rate > 0)"
_REL = " + ".join(f"CASE WHEN r.{c} <> 0 THEN abs(m.{c} - r.{c}) / abs(r.{c}) ELSE abs(m.{c}) END" for c in ("node_count", "avg_degree", "avg_clustering", "avg_length", "avg_angle"))


_GROUPED = """WITH RECURSIVE """ + LATTICE + """,
seg AS (SELECT c_custkey AS id, c_mktsegment AS g FROM customer),
gn AS (SELECT n.id, g, x, y FROM n JOIN seg ON seg.id = n.id),
ge AS (SELECT u, v, a.g FROM e JOIN seg a ON a.id = u JOIN seg b ON b.id = v WHERE a.g = b.g),
gs AS (SELECT u, v, g FROM ge UNION ALL SELECT v, u, g FROM ge)"""

_FILES = "(SELECT 'run/' || o_orderkey || '/' || ['a_edgelist.csv','A_Positions.CSV','snapshots/snapshot_00010_positions.npy','spectra_analysis_figure.webp','result.json','net.graphml.gz','figure.PNG','snapshots_of_report.txt'][1 + o_orderkey % 8] AS path, ['edge_lists','positions','snapshots','analysis','other','networks','previews','other'][1 + o_orderkey % 8] AS kind FROM orders)"

ORACLES: dict[str, str] = {
    "degree_distribution": _q(KNN, f"{_i('deg AS degree', 'n')}, {_f('n / sum(n) OVER () AS share')} FROM (SELECT deg, count(*) AS n FROM d GROUP BY deg)"),
    "degree_transitions": _q(KNN, _TRANS),
    "supply_transitions": _q(SUPPLY, _TRANS),
    "degree_lengths": _q(KNN, f"{_i('d.deg AS degree', 'count(*) AS n')}, {_f('avg(len) AS mean')} FROM pe JOIN d ON d.id = pe.u GROUP BY d.deg"),
    "degree_angles": _q(KNN, f"{_i('d.deg AS degree', 'count(*) AS n')}, {_f('max(gap) AS widest')} FROM gaps JOIN d ON d.id = node_id GROUP BY d.deg"),
    "edge_lengths": _q(KNN, f"{_i('u', 'v')}, {_f('len AS length', 'ang AS angle')} FROM pl"),
    "angle_gaps": _q(LATTICE, f"{_i('node_id', 'seq')}, {_f('gap')} FROM gaps"),
    "network_metrics": _q(KNN, f"{_i('node_count')}, {_f('avg_degree', 'avg_clustering', 'avg_length', 'avg_angle')} FROM met"),
    "weighted_degree": _q(TRADE, f"{_i('id AS node_id', 'deg AS degree')}, {_f('strength')} FROM d"),
    "clustering_local": _q(KNN, f"{_i('id AS node_id')}, {_f('c AS clustering')} FROM cl"),
    "clustering_onnela": _q(TRADE, f"{_i('id AS node_id')}, {_f('o AS clustering')} FROM cl"),
    "triangles": _q(KNN, f"{_i('a', 'b', 'c')} FROM tri"),
    "assortativity": _q(KNN, f"{_f('corr(a.deg, b.deg) AS assortativity')} FROM s JOIN d a ON s.u = a.id JOIN d b ON s.v = b.id"),
    "components": _q(LATTICE, f"{_i('id AS node_id', 'label')} FROM lab", LABELS),
    "connectivity": _q(LATTICE, f"{_i('count(*) AS n_components', 'max(size) AS top1', '(SELECT size FROM sizes ORDER BY size DESC LIMIT 1 OFFSET 1) AS top2')}, {_f('max(size) / sum(size) AS lcc_share')}, count(*) <= 1 AS connected FROM sizes", LABELS),
    "lcc_nodes": _q(LATTICE, f"{_i('n.id AS node_id')}, {_f('x', 'y')} FROM n JOIN lab ON lab.id = n.id WHERE label = (SELECT label FROM sizes ORDER BY size DESC, label LIMIT 1)", LABELS),
    "induced_subgraph": _q(LATTICE, f"{_i('a.k AS u', 'b.k AS v')} FROM e JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n WHERE id % 3 <> 0) a ON a.id = e.u JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n WHERE id % 3 <> 0) b ON b.id = e.v"),
    "trim_topk_round1": _q(LATTICE, f"{_i('u', 'v')} FROM (SELECT u, v, row_number() OVER (ORDER BY greatest(a.deg, b.deg), u, v) AS k FROM e JOIN d a ON a.id = u JOIN d b ON b.id = v) WHERE k <= (SELECT CASE WHEN 2.0 * (SELECT count(*) FROM e) / count(*) > 2.2::DOUBLE THEN floor(1.1::DOUBLE * 2.0::DOUBLE * count(*) / 2) ELSE (SELECT count(*) FROM e) END FROM n)"),
    "frame_filter": _q(LATTICE, f"{_i('u', 'v')} FROM e WHERE u IN (SELECT id FROM inside) AND v IN (SELECT id FROM inside)", ", f AS (SELECT avg(x) AS cx, avg(y) AS cy FROM n), inside AS (SELECT id FROM n, f WHERE x BETWEEN round(cx - 100, 2) AND round(cx + 100, 2) AND y BETWEEN round(cy - 75, 2) AND round(cy + 75, 2))"),
    "orient_rot90": _q(LATTICE, f"{_i('id AS node_id')}, {_f('(SELECT min(x) FROM n) + ((SELECT max(y) - min(y) FROM n) - (y - (SELECT min(y) FROM n))) AS x', '(SELECT min(y) FROM n) + (x - (SELECT min(x) FROM n)) AS y')} FROM n"),
    "transposed_positions": _q(LATTICE, f"{_i('id AS node_id')}, {_f('y AS x', 'x AS y')} FROM n"),
    "apsp_hops": _q(KNN, f"{_i('src', 'dst', 'd')} FROM hop", HOPS),
    "apsp_frontier": _q(TRADE, f"{_i('src', 'dst', 'd')} FROM hop", HOPS),
    "apsp_weighted": _q(TRADE, f"{_i('src', 'dst')}, {_f('min(d) AS d')} FROM path GROUP BY src, dst", ", path(src, dst, d, k) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM n UNION SELECT src, dst, d, k FROM (SELECT p.src, s.v AS dst, min(p.d + 1 / s.w) AS d, p.k + 1 AS k FROM path p JOIN s ON s.u = p.dst WHERE p.k < 8 GROUP BY 1, 2, 4))"),
    "ball_histogram": _q(KNN, f"{_i('src', 'r', 'cnt')} FROM ball", HOPS),
    "ball_mass": _q(KNN, f"{_i('src', 'r', 'mass')} FROM mass", HOPS),
    "partition_function": _q(KNN, f"{_i('r')}, {_f('q', 'ln(z) AS lnz')} FROM z", HOPS),
    "tau_q": _q(KNN, f"{_f('q', 'tau')} FROM tau", HOPS, 20),
    "spectrum": _q(KNN, f"{_f('q', 'alpha', 'f')} FROM spec", HOPS),
    "feature_pair": _q(KNN, f"{_f('(SELECT alpha FROM spec WHERE f >= (SELECT max(f) FROM spec) - 1e-9 ORDER BY q LIMIT 1) AS holder_exponent', 'max(alpha) - min(alpha) AS spectrum_width')} FROM spec", HOPS),
    "dimension_q": _q(KNN, f"{_f('q', 'tau / q AS dim')} FROM tau WHERE q <> 0", HOPS),
    "node_dimension": _q(KNN, f"{_i('src AS node_id')}, {_f('CASE WHEN count(*) > 2 THEN regr_slope(ln(inside), ln(r)) ELSE 0.0 END AS dimension')} FROM (SELECT src, r, 1 + sum(cnt) OVER (PARTITION BY src ORDER BY r) AS inside FROM ball) GROUP BY src", HOPS),
    "closeness": _q(KNN, f"{_i('src AS node_id')}, {_f('(count(*) - 1)::DOUBLE / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM n) - 1) AS closeness')} FROM hop GROUP BY src", HOPS),
    "diameter": _q(KNN, f"{_i('max(d) AS diameter')} FROM hop", HOPS),
    "neighbour_masses": _q(TRADE, f"{_i('u', 'v')}, {_f('0.5 * exp(x - mx) / sum(exp(x - mx)) OVER (PARTITION BY u) AS mass')} FROM (SELECT u, v, -(1 / w) * (1 / w) AS x, max(-(1 / w) * (1 / w)) OVER (PARTITION BY u) AS mx FROM s)"),
    "knn_pairs": f"WITH {KNN} SELECT {_i('u', 'v', 'r AS rank')}, {_f('d AS distance')} FROM near WHERE r <= 4",
    "range_pairs_grid": _q(LATTICE, f"{_i('a.id AS a', 'b.id AS b')}, {_f('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance')} FROM n a JOIN n b ON a.id < b.id AND abs(a.x - b.x) < 15 AND abs(a.y - b.y) < 15 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 15"),
    "nearest_other": _q(LATTICE, f"{_i('a.id AS node_id')}, {_f('min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS distance')} FROM n a JOIN n b ON a.id <> b.id GROUP BY a.id"),
    "segment_intersections": _q(
        KNN,
        f"{_i('a.u AS u1', 'a.v AS v1', 'b.u AS u2', 'b.v AS v2')} FROM pl a JOIN pl b ON (a.u < b.u OR (a.u = b.u AND a.v < b.v)) AND a.u <> b.u AND a.u <> b.v AND a.v <> b.u AND a.v <> b.v "
        "WHERE sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) <> sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) "
        "AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) <> sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1))",
    ),
    "pareto_front": f"SELECT {_i('o_orderkey')}, {_f('error', 'success_rate')} FROM {_TRIALS} t WHERE success_rate > 0 AND NOT EXISTS (SELECT 1 FROM {_TRIALS} o WHERE o.success_rate > 0 AND o.error <= t.error AND o.success_rate >= t.success_rate AND (o.error < t.error OR o.success_rate > t.success_rate))",
    "combined_score": f"SELECT {_i('o_orderkey')}, {_f('score')} FROM {_SCORE}",
    "near_one": f"SELECT {_i('o_orderkey')}, {_f('node_factor', 'edge_factor')} FROM {_TRIALS} WHERE abs(node_factor - 1) <= 0.25 AND abs(edge_factor - 1) <= 0.25",
    "best_trials": f"SELECT {_i('o_orderkey')}, {_f('score')} FROM {_SCORE} ORDER BY score DESC, error, o_orderkey LIMIT 15",
    "robust_mean_error": f"WITH t AS (SELECT o_custkey % 10 AS trial, o_totalprice / 1000 AS error FROM orders), m AS (SELECT trial, avg(error) AS mu, stddev_pop(error) AS sd FROM t GROUP BY trial) SELECT {_i('t.trial AS trial')}, {_f('round(avg(error), 3) AS error')} FROM t JOIN m ON m.trial = t.trial WHERE abs(error - mu) <= 2 * sd GROUP BY t.trial",
    "factor_grid": f"WITH t AS (SELECT min(node_factor) AS n0, max(node_factor) AS n1, min(edge_factor) AS e0, max(edge_factor) AS e1 FROM {_TRIALS}), a AS (SELECT round(n0 + unnest(range(0, round((n1 - n0) / 0.1)::BIGINT + 1)) * 0.1, 6) AS f FROM t), b AS (SELECT round(e0 + unnest(range(0, round((e1 - e0) / 0.1)::BIGINT + 1)) * 0.1, 6) AS f FROM t) SELECT {_f('a.f AS node_factor', 'b.f AS edge_factor')} FROM a, b",
    "session_transitions": f"WITH t AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT {_i('n')}, {_f('n / sum(n) OVER (PARTITION BY event_type) AS prob')}, event_type, nxt AS next FROM (SELECT event_type, nxt, count(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY 1, 2)",
    "manifest_classify": f"SELECT count(*)::BIGINT AS n, kind FROM {_FILES} GROUP BY kind",
    "manifest_summary": f"SELECT 'ok' AS status, 'run' AS run_root, count(*)::BIGINT AS file_count, count(DISTINCT kind)::BIGINT AS kinds FROM {_FILES}",
    "log_progress": f"SELECT {_f('arg_max(p, ts) AS percent')}, 'run' || (user_id % 20) AS run_id, event_type AS dataset FROM (SELECT *, least((event_id % 131) / 131.0::DOUBLE * 100, 99.0) AS p FROM events WHERE event_id % 17 <> 0) GROUP BY user_id % 20, event_type",
    "edge_existence": _q(TRADE, f"{_i('a.id AS u', 'b.id AS v')}, {_f('coalesce(s.w, 0.0) AS weight')} FROM n a CROSS JOIN (SELECT unnest(range(0, 25)) AS id) b LEFT JOIN s ON s.u = a.id AND s.v = b.id"),
    "plot_segments": _q(LATTICE, f"{_i('u', 'v')}, {_f('x1', 'y1', 'x2', 'y2', 'median(len) OVER () AS median')} FROM pl"),
}

_BINS = """,
k AS (SELECT len, row_number() OVER (ORDER BY len) AS k, count(*) OVER () AS n FROM pl),
cut AS (SELECT min(len) AS lo, max(len) AS hi, max(CASE WHEN k = n // 3 + 1 THEN len END) AS t1, max(CASE WHEN k = 2 * n // 3 + 1 THEN len END) AS t2, any_value(n) AS n FROM k),
bins AS (SELECT b AS bin, CASE WHEN n <= 100 THEN lo + (hi - lo) * b / 100.0 WHEN b < 50 THEN lo + (t1 - lo) * b / 50.0 WHEN b < 80 THEN t1 + (t2 - t1) * (b - 50) / 30.0 ELSE t2 + (hi - t2) * (b - 80) / 20.0 END AS lo,
  CASE WHEN n <= 100 THEN lo + (hi - lo) * (b + 1) / 100.0 WHEN b < 50 THEN lo + (t1 - lo) * (b + 1) / 50.0 WHEN b < 80 THEN t1 + (t2 - t1) * (b - 49) / 30.0 ELSE t2 + (hi - t2) * (b - 79) / 20.0 END AS hi FROM cut, (SELECT unnest(range(0, 100)) AS b))"""
ORACLES["length_bins"] = _q(KNN, f"{_i('bin')}, {_f('lo', 'hi')} FROM bins", _BINS)
ORACLES["bin_assignment"] = _q(KNN, f"{_i('u', 'v', '(SELECT greatest(0, count(*) - 1) FROM bins WHERE bins.lo <= pl.len) AS bin')} FROM pl", _BINS)
ORACLES["weight_mapper"] = _q(
    TRADE,
    f"{_i('bins.bin AS bin', 'count(a.u) AS n')}, {_f('(SELECT avg(w) FROM e) AS fallback')} FROM bins LEFT JOIN a ON a.bin = bins.bin GROUP BY bins.bin",
    _BINS + ", a AS (SELECT u, v, (SELECT greatest(0, count(*) - 1) FROM bins WHERE bins.lo <= pl.len) AS bin FROM pl)",
)
ORACLES["network_info"] = " UNION ALL ".join(
    f"(WITH {net} SELECT (SELECT count(*) FROM n)::BIGINT AS node_count, (SELECT count(*) FROM e)::BIGINT AS edge_count, '{g}' AS graph_id)" for g, net in (("knn", KNN), ("lattice", LATTICE), ("trade", TRADE))
)
ORACLES["metric_distance"] = f"WITH m AS ({_q(LATTICE, '* FROM met')}), r AS ({_q(KNN, '* FROM met')}) SELECT {_f(f'({_REL}) / 5 AS distance')} FROM m, r"
ORACLES["rank_candidates"] = (
    _GROUPED
    + """, gd AS (SELECT gn.g, gn.id, count(gs.u) AS deg FROM gn LEFT JOIN gs ON gs.u = gn.id GROUP BY 1, 2),
ga AS (SELECT gs.g, gs.u, atan2(b.y - a.y, b.x - a.x) FROM gs JOIN n a ON a.id = gs.u JOIN n b ON b.id = gs.v),
gm AS (SELECT gd.g, count(*) AS node_count, avg(deg) AS avg_degree, 0.0 AS avg_clustering, coalesce(360.0 * count(*) FILTER (deg > 1) / nullif(sum(deg) FILTER (deg > 1), 0), 0.0) AS avg_angle FROM gd GROUP BY gd.g),
gl AS (SELECT ge.g, avg(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS avg_length FROM ge JOIN n a ON a.id = u JOIN n b ON b.id = v GROUP BY ge.g),
m AS (SELECT gm.*, coalesce(gl.avg_length, 0.0) AS avg_length FROM gm LEFT JOIN gl ON gl.g = gm.g),
r AS ("""
    + _q(LATTICE, "* FROM met")
    + f"), dist AS (SELECT m.g, ({_REL}) / 5 AS distance FROM m, r) SELECT {_i('row_number() OVER (ORDER BY distance, g) AS rank')}, {_f('distance')}, g AS graph_id FROM dist"
)
ORACLES["weight_assignment_given"] = _q(
    TRADE,
    f"{_i('u', 'v')}, {_f('coalesce(seen[1 + floor(draw * len(seen))::INTEGER], (SELECT avg(w) FROM e)) AS weight')} FROM (SELECT u, v, bin, ((u * 7919 + v * 104729) % 10007 + 0.5) / 10007::DOUBLE AS draw FROM a) LEFT JOIN (SELECT bin, list(w ORDER BY w) AS seen FROM a JOIN e USING (u, v) GROUP BY bin) USING (bin)",
    _BINS + ", a AS (SELECT u, v, (SELECT greatest(0, count(*) - 1) FROM bins WHERE bins.lo <= pl.len) AS bin FROM pl)",
)
