"""The SQL table function: rows of the nodes asked for alone, counted over all edges, by Arrow batches."""

import pytest

from filigree.functions import sql

EDGES = [("g", i, i + 1) for i in range(6)] + [("h", 3, 5), ("h", 5, 8)]


@pytest.mark.parametrize("asked", [set(), {2, 5}, set(range(9))])
def test_only_nodes_asked_for_have_rows(spark, asked):
    sql.register(spark)
    rows = [(*e, e[1] in asked, e[2] in asked) for e in EDGES]
    spark.createDataFrame(rows, "graph_id string, u long, v long, u_asked boolean, v_asked boolean").createOrReplaceTempView("flagged")
    spark.createDataFrame(EDGES, "graph_id string, u long, v long").createOrReplaceTempView("plain")
    of = lambda view: spark.sql(f"SELECT * FROM sp_histogram(TABLE({view}) PARTITION BY graph_id)")
    whole = [tuple(r) for r in of("plain").collect()]
    assert ("g", 2, 1.0, 2) in whole and ("g", 2, 4.0, 1) in whole and ("h", 5, 1.0, 2) in whole
    assert sorted(map(tuple, of("flagged").collect())) == sorted(r for r in whole if r[1] in asked)
