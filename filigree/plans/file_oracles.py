"""DuckDB SQL for the queries that go through files, builders, gates and growth."""

from __future__ import annotations

from .oracles import _DEG_PAIRS, _GROUPED, _TRIALS, HOPS, KNN, LABELS, LATTICE, ORACLES, SUPPLY, TRADE, _f, _i, _q

_EDGES = f"{_i('u', 'v')}, {_f('w AS weight')} FROM e"
_FEATURES = "(SELECT alpha FROM spec WHERE f >= (SELECT max(f) FROM spec) - 1e-9 ORDER BY q LIMIT 1) AS h, max(alpha) - min(alpha) AS wide FROM spec"
_PLACED = f"{_f('x1', 'y1', 'x2', 'y2')}, round(({{w}})::DOUBLE, 6) AS weight, 'made/{{name}}' AS graph_id FROM pl"
_GRID = f"(SELECT node_factor, edge_factor, max(error) AS error, min(success_rate) AS success_rate FROM {_TRIALS} GROUP BY 1, 2)"
_CELLS = "c AS (SELECT o_custkey % 60 AS u, o_orderkey % 60 AS v, o_totalprice::DOUBLE AS w, o_orderkey AS k FROM orders)"
#: The first of the rounds, and the factor by which the next one grows (1: by one more than the last).
_ROUNDS = "r(every, factor, round) AS (SELECT every, factor, 1 FROM (VALUES (-1, 2.0::DOUBLE), (-3, 500.0::DOUBLE ** (1.0::DOUBLE / 3)), (-6, 500.0::DOUBLE ** (1.0::DOUBLE / 6))) t(every, factor) UNION ALL SELECT every, factor, greatest(round + 1, floor(round * factor)::INTEGER) FROM r WHERE greatest(round + 1, floor(round * factor)::INTEGER) <= 500)"
#: Segments' mean lengths and gaps beside the whole lattice's.
_SEGMENTS = (
    _GROUPED
    + f""", gd AS (SELECT gn.g, gn.id, count(gs.u) AS deg FROM gn LEFT JOIN gs ON gs.u = gn.id GROUP BY 1, 2),
ga AS (SELECT g, coalesce(360.0 * count(*) FILTER (deg > 1) / nullif(sum(deg) FILTER (deg > 1), 0), 0.0) AS a FROM gd GROUP BY g),
gl AS (SELECT ge.g, avg(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS l FROM ge JOIN n a ON a.id = u JOIN n b ON b.id = v GROUP BY ge.g),
r AS ({_q(LATTICE, "avg_length, avg_angle FROM met")})"""
)

#: Shortest paths counted level by level, and every node's share of them.
_BETWEEN = """,
sig(src, dst, d, k) AS (SELECT id, id, 0, 1.0::DOUBLE FROM n UNION ALL
  SELECT p.src, s.v, p.d + 1, sum(p.k) FROM sig p JOIN s ON p.dst = s.u JOIN hop h ON h.src = p.src AND h.dst = s.v AND h.d = p.d + 1 GROUP BY 1, 2, 3),
dep AS (SELECT a.dst AS id, sum(a.k * b.k / t.k) AS b FROM sig a JOIN sig b ON b.src = a.dst JOIN sig t ON t.src = a.src AND t.dst = b.dst AND t.d = a.d + b.d WHERE a.src <> a.dst AND b.dst <> a.dst AND a.src <> b.dst GROUP BY a.dst),
btw AS (SELECT n.id, coalesce(b, 0.0) / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2)) AS b FROM n LEFT JOIN dep ON dep.id = n.id)"""
#: Power iteration on the adjacency shifted by half the largest degree; the networks hang together.
_POWER = """,
it(k, id, x) AS (SELECT 0, id, 1 / sqrt((SELECT count(*) FROM n)::DOUBLE) FROM n UNION ALL
  SELECT k + 1, id, y / sqrt(sum(y * y) OVER ()) FROM (SELECT any_value(i.k) AS k, i.id, any_value(i.x) * (SELECT max(strength) / 2.0 FROM d) + coalesce(sum(s.w * o.x), 0.0) AS y FROM it i LEFT JOIN s ON s.u = i.id LEFT JOIN it o ON o.id = s.v GROUP BY i.id) WHERE k < 3000),
eig AS (SELECT id, x FROM it WHERE k = 3000)"""
#: Weighted distance of every node from its component's smallest id.
_FAR = """,
sl AS MATERIALIZED (SELECT u, v, len FROM pl UNION ALL SELECT v, u, len FROM pl),
far(id, d) USING KEY (id) AS (SELECT DISTINCT label, 0.0::DOUBLE FROM lab UNION SELECT sl.v, min(f.d + sl.len) FROM far f JOIN sl ON sl.u = f.id LEFT JOIN recurring.far r ON r.id = sl.v WHERE r.d IS NULL OR f.d + sl.len < r.d GROUP BY sl.v)"""
#: Shortest weighted distances, a link as long as {one} over its weight.
_LENGTHS = ", path(src, dst, d, k) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM n UNION SELECT src, dst, d, k FROM (SELECT p.src, s.v AS dst, min(p.d + {one} / s.w) AS d, p.k + 1 AS k FROM path p JOIN s ON s.u = p.dst WHERE p.k < 8 GROUP BY 1, 2, 4)), pd AS MATERIALIZED (SELECT src, dst, min(d) AS d FROM path GROUP BY 1, 2)"
_NFD = "nfd AS (SELECT src, CASE WHEN count(*) > 2 THEN regr_slope(ln(inside), ln(r)) ELSE 0.0 END AS x FROM (SELECT src, r, 1 + sum(cnt) OVER (PARTITION BY src ORDER BY r) AS inside FROM ball) GROUP BY src)"
_CLOSE = "clo AS (SELECT src, (count(*) - 1)::DOUBLE / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM n) - 1) AS x FROM hop GROUP BY src)"

_TRIALS_ERROR, _TRIALS_RATE = "error, success_rate DESC, node_factor, o_orderkey", "success_rate DESC, error, node_factor, o_orderkey"

SQL = {
    "betweenness": _q(KNN, f"{_i('id AS node_id')}, {_f('b AS betweenness')} FROM btw", HOPS + _BETWEEN),
    "betweenness_trade": _q(TRADE, f"{_i('id AS node_id')}, {_f('b AS betweenness')} FROM btw", HOPS + _BETWEEN),
    "eigenvector": _q(KNN, f"{_i('id AS node_id')}, {_f('x AS eigenvector')} FROM eig", _POWER),
    "eigenvector_weighted": _q(TRADE, f"{_i('id AS node_id')}, {_f('x AS eigenvector')} FROM eig", _POWER),
    "centralities": _q(KNN, f"{_i('n.id AS node_id', 'd.deg AS degree')}, {_f('nfd.x AS dimension', 'clo.x AS closeness', 'cl.c AS clustering')} FROM n JOIN d ON d.id = n.id JOIN nfd ON nfd.src = n.id JOIN clo ON clo.src = n.id JOIN cl ON cl.id = n.id", HOPS + ", " + _NFD + ", " + _CLOSE),
    "analysis_summary": _q(
        KNN,
        f"{_i('(SELECT count(*) FROM tau) AS n_q', '(SELECT max(d) FROM hop) AS diameter')}, "
        + _f(
            "(SELECT max(tau / q) - min(tau / q) FROM tau WHERE q <> 0) AS dim_diff",
            "(SELECT alpha FROM spec WHERE f >= (SELECT max(f) FROM spec) - 1e-9 ORDER BY q LIMIT 1) AS holder_exp",
            "(SELECT alpha FROM spec WHERE f >= (SELECT max(f) FROM spec) - 1e-9 ORDER BY q DESC LIMIT 1) AS other_branch",
            "(SELECT max(alpha) - min(alpha) FROM spec) AS width",
            "(SELECT corr(a.deg, b.deg) FROM s JOIN d a ON s.u = a.id JOIN d b ON s.v = b.id) AS assortativity",
            "(SELECT avg(x) FROM nfd) AS avg_nfd",
            "(SELECT avg(x) FROM clo) AS avg_closeness",
            "(SELECT avg(deg) FROM d) AS avg_degree",
            "(SELECT avg(c) FROM cl) AS avg_clustering",
            "(SELECT avg(b) FROM btw) AS avg_betweenness",
            "(SELECT avg(x) FROM eig) AS avg_eigen",
        ),
        HOPS + _BETWEEN + _POWER + ", " + _NFD + ", " + _CLOSE,
        20,
    ),
    "gate_multifractal_wide": f"SELECT {_f('sqrt((a.h - b.h) ** 2 + (a.wide - b.wide) ** 2) AS error')}, 'trade' AS graph_id, TRUE AS passed FROM ({_q(TRADE, _FEATURES, HOPS, 20)}) a, ({_q(KNN, _FEATURES, HOPS, 20)}) b",
    "stream_degree_changes": f"WITH {LATTICE}, f AS (SELECT u, v FROM e WHERE u % 3 <> 0 OR u % 6 = 0), t AS (SELECT u AS id FROM f UNION ALL SELECT v FROM f), a AS (SELECT u AS id FROM e UNION SELECT v FROM e) SELECT {_i('a.id AS node_id', 'count(t.id) AS degree', 'count(t.id) AS edges')} FROM a LEFT JOIN t ON t.id = a.id GROUP BY a.id",
    "sp_histogram_sql": _q(LATTICE, f"{_i('src', 'cnt')}, {_f('r')} FROM ball JOIN n ON n.id = src WHERE x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 300", HOPS),
    "betweenness_levels": _q(KNN, f"{_i('id AS node_id')}, {_f('b AS betweenness')} FROM btw", HOPS + _BETWEEN),
    "eigenvector_lanczos": _q(TRADE, f"{_i('id AS node_id')}, {_f('x AS eigenvector')} FROM eig", _POWER),
    "weighted_reach": _q(LATTICE, f"{_i('label AS src', 'far.id AS dst')}, {_f('d')} FROM far JOIN lab ON lab.id = far.id", LABELS + _FAR),
    "nearest_observations": f"WITH {LATTICE}, l AS (SELECT DISTINCT sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM e JOIN n a ON a.id = u JOIN n b ON b.id = v), o AS (SELECT (l_extendedprice / 1000)::DOUBLE AS x, l_quantity::DOUBLE AS y FROM lineitem), r AS (SELECT len, sqrt((x - len) ** 2 + y ** 2) AS d, y, row_number() OVER (PARTITION BY len ORDER BY (x - len) ** 2 + y ** 2, x, y) AS k FROM l, o) SELECT {_i('count(*) AS n')}, {_f('len AS length', 'sum(d) AS d', 'sum(y) AS weight')} FROM r WHERE k <= 50 GROUP BY len",
    "ball_sketches": _q(KNN, f"{_i('r', 'pairs')}, TRUE AS near FROM (SELECT d AS r, sum(count(*)) OVER (ORDER BY d) AS pairs FROM hop GROUP BY d)", HOPS),
    "ball_histogram_weighted": _q(TRADE, f"{_i('src', 'count(*) AS cnt')}, {_f('r')} FROM (SELECT src, round(d, 1) AS r FROM pd WHERE d > 0) GROUP BY src, r", _LENGTHS.replace("{one}", "1000")),
    "node_dimension_weighted": _q(TRADE, f"{_i('id AS node_id')}, {_f('CASE WHEN k > 2 THEN s ELSE 0.0 END AS dimension')} FROM n LEFT JOIN (SELECT src, count(*) AS k, regr_slope(ln(inside), ln(r)) AS s FROM (SELECT src, r, sum(cnt) OVER (PARTITION BY src ORDER BY r) AS inside FROM (SELECT src, round(d, 1) AS r, count(*) AS cnt FROM pd WHERE d > 0 GROUP BY ALL)) GROUP BY src) ON src = id", _LENGTHS.replace("{one}", "1000")),
    "centralities_weighted": _q(TRADE, f"{_i('n.id AS node_id')}, 0.0::DOUBLE AS dimension, {_f('coalesce((f.c - 1) / nullif(far, 0) * (f.c - 1) / ((SELECT count(*) FROM n) - 1), 0.0) AS closeness', 'strength AS degree', 'o AS clustering')} FROM n JOIN d ON d.id = n.id JOIN cl ON cl.id = n.id JOIN (SELECT src, count(*)::DOUBLE AS c, sum(d) AS far FROM pd GROUP BY src) f ON f.src = n.id", _LENGTHS.replace("{one}", "1")),
    "snapshot_networks": f"{_GROUPED}, reach(g, id, label) AS (SELECT g, id, id FROM gn UNION SELECT r.g, gs.v, r.label FROM reach r JOIN gs ON gs.g = r.g AND gs.u = r.id WHERE r.label < gs.v), lab AS (SELECT g, id, min(label) AS label FROM reach GROUP BY g, id), big AS (SELECT g, max(k) AS size FROM (SELECT g, label, count(*) AS k FROM lab GROUP BY g, label) GROUP BY g) SELECT {_i('dense_rank() OVER (ORDER BY s.g) AS snapshot_ix', 's.k AS node_count', 'coalesce(t.k, 0) AS edge_count', 'size')} FROM (SELECT g, count(*) AS k FROM gn GROUP BY g) s LEFT JOIN (SELECT g, count(*) AS k FROM ge GROUP BY g) t ON t.g = s.g JOIN big ON big.g = s.g",
    "log_tail": f"SELECT {_i('count(*) AS n')}, {_f('sum(event_id % 131) AS percent')}, 'run' || (user_id % 20) AS run_id, event_type AS dataset FROM events WHERE event_id % 17 <> 0 GROUP BY user_id % 20, event_type",
    "format_networks": f"SELECT * FROM ({_q(TRADE, _PLACED.format(name='trade', w='w'))}) UNION ALL SELECT * FROM ({_q(LATTICE, _PLACED.format(name='lattice', w='-1.0'))})",
    "csv_pair_edges": _q(TRADE, _EDGES),
    "csv_pair_positions": _q(TRADE, f"{_i('id AS node_id')}, {_f('x', 'y')} FROM n"),
    "graphml_edges": _q(TRADE, _EDGES),
    "graphml_positions": _q(TRADE, f"{_i('id AS node_id')}, {_f('x', 'y')} FROM n"),
    "folder_set": " UNION ALL ".join(f"(WITH {net} SELECT (SELECT count(*) FROM n)::BIGINT AS node_count, (SELECT count(*) FROM e)::BIGINT AS edge_count, '{g}' AS graph_id)" for g, net in (("knn", KNN), ("trade", TRADE))),
    "named_network": _q(LATTICE, f"{_i('(SELECT count(*) FROM big) AS node_count', 'count(*) AS edge_count')} FROM e WHERE u IN (SELECT id FROM big)", LABELS + ", big AS (SELECT id FROM lab WHERE label = (SELECT label FROM sizes ORDER BY size DESC, label LIMIT 1))"),
    "triples_network": _q(
        TRADE,
        f"{_i('a.k AS u', 'b.k AS v')}, {_f('w AS weight')} FROM e JOIN big a ON a.id = e.u JOIN big b ON b.id = e.v",
        LABELS + ", big AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM lab WHERE label = (SELECT label FROM sizes ORDER BY size DESC, label LIMIT 1))",
    ),
    "matrix_network": f"WITH {_CELLS} SELECT {_i('least(u, v) AS u', 'greatest(u, v) AS v')}, {_f('arg_min(w, k) AS weight')} FROM c WHERE u <> v GROUP BY least(u, v), greatest(u, v)",
    "edge_list_network": f"WITH {_CELLS} SELECT DISTINCT {_i('least(u, v) AS u', 'greatest(u, v) AS v')} FROM c",
    "last_weights": f"WITH {_CELLS} SELECT {_i('least(u, v) AS u', 'greatest(u, v) AS v')}, {_f('arg_max(w, k) AS weight')} FROM c GROUP BY least(u, v), greatest(u, v)",
    "position_network": _q(LATTICE, f"{_i('u', 'v')} FROM e"),
    "weight_views": f"({_q(LATTICE, _i('u', 'v') + ', 1.0::DOUBLE AS weight, ' + chr(39) + 'lattice' + chr(39) + ' AS graph_id FROM e')}) UNION ALL ({_q(TRADE, _i('u', 'v') + ', 1.0::DOUBLE AS weight, ' + chr(39) + 'trade' + chr(39) + ' AS graph_id FROM e')})",
    "inverse_lengths": _q(TRADE, f"{_i('u', 'v')}, {_f('1 / w AS weight')} FROM e"),
    "edges_removed": _q(LATTICE, f"{_i('u', 'v')} FROM e WHERE (u + v) % 3 <> 0"),
    "positions_moved": _q(LATTICE, f"{_i('id AS node_id')}, {_f('CASE WHEN id % 5 = 0 THEN x + 1 ELSE x END AS x', 'CASE WHEN id % 5 = 0 THEN y * 2 ELSE y END AS y')} FROM n"),
    "neighbours_of_node": _q(TRADE, f"DISTINCT {_i('v AS node_id')} FROM s WHERE u = 3"),
    "polar_points": f"SELECT {_i('o_orderkey')}, {_f('1 + o_totalprice / 1000 * cos(radians(o_orderkey % 360)) AS x', '2 + o_totalprice / 1000 * sin(radians(o_orderkey % 360)) AS y')} FROM orders",
    "trials_file": f"SELECT {_f('node_factor', 'edge_factor', 'error', 'success_rate')} FROM {_GRID}",
    "sweep_report": f"SELECT {_f('node_factor', 'edge_factor')}, printf('%.6f', error::DOUBLE) AS error, printf('%.4f', success_rate::DOUBLE) AS success_rate FROM {_GRID}",
    "snapshot_files": "SELECT o_orderkey::BIGINT AS snapshot_ix, printf('run/snapshots/snapshot_%08d_positions.npy', o_orderkey) AS positions, printf('run/snapshots/snapshot_%08d_edges.npy', o_orderkey) AS edges FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0",
    "graph_attributes": _q(KNN, f"{_i('degree_u', 'degree_v')}, {_f('n / sum(n) OVER (PARTITION BY degree_u) AS prob', '(SELECT avg(len) FROM pl) AS average_length', '(SELECT avg(deg) FROM d) AS average_degree')} FROM ({_DEG_PAIRS})"),
    "report_text": _q(
        TRADE,
        "* FROM (SELECT 'nodes: ' || (SELECT count(*) FROM n) AS line UNION ALL SELECT 'edges: ' || (SELECT count(*) FROM e) UNION ALL SELECT printf('average length: %.4f', (SELECT avg(len) FROM pl)) UNION ALL SELECT printf('average degree: %.4f', (SELECT avg(deg)::DOUBLE FROM d)) UNION ALL SELECT 'degree distribution:' "
        "UNION ALL SELECT printf('  degree %d: %.4f', deg, count(*) / (SELECT count(*) FROM n)::DOUBLE) FROM d GROUP BY deg)",
    ),
    "augmented_reports": f"SELECT {_i('o_custkey % 12 AS label')}, {_f('avg(o_totalprice / 1000) FILTER (o_orderkey % 7 <> 0) AS avg_nfd', 'avg(o_orderkey % 5) AS avg_degree')}, -1.0::DOUBLE AS avg_ricci FROM orders GROUP BY o_custkey % 12",
    "spectra_points": _q(KNN, f"{_i('row_number() OVER (ORDER BY q) - 1 AS ix')}, {_f('alpha', 'f')}, 'own' AS label FROM spec", HOPS, 20),
    "stream_degrees": _q(LATTICE, f"{_i('id AS node_id', 'deg AS degree')} FROM d WHERE deg > 0"),
    "stream_progress": f"SELECT {_f('arg_max(event_id % 131, ts) AS percent')}, 'run' || (user_id % 20) AS run_id, event_type AS dataset FROM events WHERE event_id % 17 <> 0 GROUP BY user_id % 20, event_type",
    "cropped_component": _q(
        LATTICE,
        f"{_i('u', 'v')} FROM e2 WHERE u IN (SELECT id FROM lab2 WHERE label = (SELECT label FROM lab2 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1))",
        """, f AS (SELECT avg(x) AS cx, avg(y) AS cy FROM n),
inside AS MATERIALIZED (SELECT id FROM n, f WHERE x BETWEEN round(cx - 60, 2) AND round(cx + 60, 2) AND y BETWEEN round(cy - 45, 2) AND round(cy + 45, 2)),
e2 AS MATERIALIZED (SELECT u, v FROM e WHERE u IN (SELECT id FROM inside) AND v IN (SELECT id FROM inside)),
s2 AS MATERIALIZED (SELECT u, v FROM e2 UNION ALL SELECT v, u FROM e2),
reach2(id, label) AS (SELECT id, id FROM inside UNION SELECT s2.v, r.label FROM reach2 r JOIN s2 ON s2.u = r.id WHERE r.label < s2.v),
lab2 AS (SELECT id, min(label) AS label FROM reach2 GROUP BY id)""",
    ),
    "orientations": _q(
        LATTICE,
        f"{_i('id AS node_id')}, {_f('x0 + a AS x', 'y0 + b AS y')}, how FROM (SELECT id, x0, y0, 'none' AS how, dx AS a, dy AS b FROM t UNION ALL SELECT id, x0, y0, 'rot180', w - dx, h - dy FROM t UNION ALL SELECT id, x0, y0, 'rot270', dy, w - dx FROM t UNION ALL SELECT id, x0, y0, 'transpose', dy, dx FROM t)",
        ", box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM n), t AS (SELECT id, x0, y0, x - x0 AS dx, y - y0 AS dy, x1 - x0 AS w, y1 - y0 AS h FROM n, box)",
    ),
    "best_by_error": f"SELECT {_i('o_orderkey')}, {_f('error', 'success_rate')} FROM {_TRIALS} WHERE success_rate > 0 ORDER BY {_TRIALS_ERROR} LIMIT 15",
    "best_by_success": f"SELECT {_i('o_orderkey')}, {_f('error', 'success_rate')} FROM {_TRIALS} WHERE success_rate > 0 ORDER BY {_TRIALS_RATE} LIMIT 7",
    "closeness_weighted": _q(
        TRADE,
        f"{_i('id AS node_id')}, {_f('coalesce((count(*) FILTER (dst <> id))::DOUBLE / nullif(sum(d), 0) * (count(*) FILTER (dst <> id)) / ((SELECT count(*) FROM n) - 1), 0.0) AS closeness')} FROM n LEFT JOIN (SELECT src, dst, min(d) AS d FROM path GROUP BY src, dst) b ON b.src = n.id GROUP BY id",
        ", path(src, dst, d, k) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM n UNION SELECT src, dst, d, k FROM (SELECT p.src, s.v AS dst, min(p.d + 1 / s.w) AS d, p.k + 1 AS k FROM path p JOIN s ON s.u = p.dst WHERE p.k < 24 GROUP BY 1, 2, 4))",
    ),
    "ranking_report": f"SELECT distance AS metric_distance, rank::VARCHAR AS rank FROM ({ORACLES['rank_candidates']}) UNION ALL SELECT 0.0, 'original'",
    "preview_bars": _q(SUPPLY, f"{_i('deg AS degree')}, {_f('k / max(k) OVER () AS bar')}, CASE WHEN k / t < 0.0005 THEN '<0.1%' ELSE printf('%.1f%%', 100 * (k / t)) END AS label FROM (SELECT deg, count(*)::DOUBLE AS k, (SELECT count(*) FROM d)::DOUBLE AS t FROM d GROUP BY deg)"),
    "preview_cells": _q(
        TRADE,
        "printf('Nodes|%d|Edges|%d|Average degree|%.4f|Average edge length|%.4f', (SELECT count(*) FROM n), (SELECT count(*) FROM e), (SELECT avg(deg)::DOUBLE FROM d), (SELECT avg(len) FROM pl)) AS cells, deg::VARCHAR AS degree, "
        "printf('%.1f%%', 100 * (count(*)::DOUBLE / (SELECT count(*) FROM d))) AS percent FROM d GROUP BY deg",
    ),
    "export_order": "SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey * 31 % 1000 END::BIGINT AS generation, 'run/len_3_n' || CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey * 31 % 1000)::VARCHAR ELSE 'x' END || '_synthetic_network_' || o_orderkey || '_edgelist.csv' AS path FROM orders",
    "every_kth_edge": _q(LATTICE, f"{_i('u', 'v')} FROM (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS k, greatest(1, count(*) OVER () // 400) AS step FROM e) WHERE k % step = 0"),
    "phase_summary": f"SELECT {_i('count(*) FILTER (error < 200) AS ok', 'count(*) FILTER (error >= 200) AS over_tolerance', '1000000 - count(*) AS failed')}, {_f('avg(error) AS mean_error')} FROM {_TRIALS}",
    "metric_lines": _q(LATTICE, "printf('nodes=%d  avg_deg=%.2f  clust=%.4f  length=%.2f  angle=%.2f', node_count, avg_degree::DOUBLE, avg_clustering::DOUBLE, avg_length::DOUBLE, avg_angle::DOUBLE) AS line FROM met"),
    "gate_length_angle": f"{_SEGMENTS} SELECT {_f('(abs(coalesce(l, 0.0) - avg_length) / avg_length + abs(a - avg_angle) / avg_angle) / 2 AS error')}, ga.g AS graph_id, (abs(coalesce(l, 0.0) - avg_length) / avg_length + abs(a - avg_angle) / avg_angle) / 2 < 0.25 AS passed FROM ga LEFT JOIN gl ON gl.g = ga.g, r",
    "gate_none": f"SELECT DISTINCT 0.0::DOUBLE AS error, c_mktsegment AS graph_id, TRUE AS passed FROM customer",
    "gate_multifractal": _q(KNN, f"{_f('sqrt((h - 2.5) ** 2 + (wide - 0.5) ** 2) AS error')} FROM (SELECT (SELECT alpha FROM spec WHERE f >= (SELECT max(f) FROM spec) - 1e-9 ORDER BY q LIMIT 1) AS h, max(alpha) - min(alpha) AS wide FROM spec)", HOPS),
    # On a line the cost is the area between the two cumulative distributions.
    "earth_movers": f"""WITH o AS (SELECT o_custkey % 40 AS g, o_orderkey % 9 AS a, floor(o_totalprice)::BIGINT % 9 AS b FROM orders),
k AS (SELECT g, x, count(*) FILTER (a <= x)::DOUBLE / count(*) AS p, count(*) FILTER (b <= x)::DOUBLE / count(*) AS q FROM o, (SELECT unnest(range(0, 9)) AS x) GROUP BY g, x) SELECT {_i('g')}, {_f('sum(abs(p - q)) AS cost')} FROM k GROUP BY g""",
    "network_extent": _q(
        LATTICE,
        "* FROM (SELECT w AS width, h AS height, 'own' AS kind FROM box UNION ALL SELECT greatest(1, ceil(w * (1024.0::DOUBLE / greatest(w, h)))), greatest(1, ceil(h * (1024.0::DOUBLE / greatest(w, h)))), 'scaled' FROM box)",
        ", box AS (SELECT greatest(1, ceil(max(x)))::DOUBLE AS w, greatest(1, ceil(max(y)))::DOUBLE AS h FROM n)",
    ),
    "snapshot_schedule": f"WITH RECURSIVE {_ROUNDS}, a AS (SELECT [-1, -3, -6, 7][c_custkey % 4 + 1] AS every, count(*) AS n FROM customer GROUP BY 1) SELECT {_i('every', 'round', 'n')} FROM (SELECT every, round FROM r UNION ALL SELECT 7, 7 * unnest(range(1, 72))) JOIN a USING (every)",
    "figure_resolution": "SELECT o_orderkey::BIGINT AS o_orderkey, n AS nodes, dpi::BIGINT AS dpi, (dpi + 300)::BIGINT AS raster FROM (SELECT o_orderkey, n, CASE WHEN n < 10000 THEN 150 WHEN n < 100000 THEN 300 WHEN n < 1000000 THEN 600 WHEN n < 10000000 THEN 900 WHEN n < 20000000 THEN 1200 ELSE 1800 END AS dpi FROM (SELECT o_orderkey, floor(o_totalprice::DOUBLE * power(10.0::DOUBLE, (o_orderkey % 5 - 1)::DOUBLE))::BIGINT AS n FROM orders))",
    "spaced_centres": "SELECT 0::BIGINT AS too_close, 0::BIGINT AS outside, TRUE AS enough",
    "grown_faults": "SELECT 0::BIGINT AS crossing, 0::BIGINT AS repeated, 0::BIGINT AS loops, 1::BIGINT AS parts, 'run/' || i AS graph_id FROM range(4) t(i)",
    "accepted_faults": "SELECT 0::BIGINT AS n, unnest(['dense', 'over_tolerance', 'apart', 'crossing']) AS fault",
    "trimmed_network": "SELECT TRUE AS within, TRUE AS connected",
    "weight_draws": _q(TRADE, f"{_i('count(*) AS n', '0 AS strange')} FROM e"),
    "mixed_weight_draws": _q(TRADE, f"{_i('count(*) AS n', '0 AS strange')} FROM e"),
    "run_outputs": "SELECT n::BIGINT AS n, kind, 'ok' AS status FROM (VALUES (3, 'edge_lists'), (3, 'positions'), (3, 'networks'), (3, 'other')) t(n, kind)",
}
ORACLES.update(SQL)
