"""Networks and run logs as Spark formats."""

import json
import os

import pytest
from pyspark.sql import functions as F

from filigree.frame import NetworkFrame
from filigree.sources import network_format as nf
from filigree.sources import sinks, tables
from filigree.streaming import tail

NODES, EDGES = "graph_id string, node_id long, x double, y double", "graph_id string, u long, v long, weight double"


def many(spark, n, weighted=True):
    nodes = [(f"g{i}", k, float(k), float(i) / 3) for i in range(n) for k in range(4)]
    edges = [(f"g{i}", k, k + 1, 0.1 * (i + k) if weighted else None) for i in range(n) for k in range(3) if i != 1]
    return NetworkFrame(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), weighted)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def stems(net):
    return net.nodes.select("graph_id").distinct().withColumn("stem", F.concat(F.lit("run/"), "graph_id"))


def files(folder):
    return sorted(os.path.relpath(os.path.join(a, f), folder) for a, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


@pytest.mark.parametrize("forms", [("csv",), ("graphml",), ("graphml.gz",)])
def test_what_is_written_is_read_back(spark, tmp_path, forms):
    net = many(spark, 5)
    nf.write_networks(net, stems(net), str(tmp_path), forms)
    back = nf.read_networks(spark, str(tmp_path))
    assert back.weighted
    assert [(r[0].removeprefix("run/"), *r[1:]) for r in rows(back.nodes, "graph_id", "node_id", "x", "y")] == rows(net.nodes, "graph_id", "node_id", "x", "y")
    assert [(r[0].removeprefix("run/"), *r[1:]) for r in rows(back.edges, "graph_id", "u", "v", "weight")] == rows(net.edges, "graph_id", "u", "v", "weight")
    assert not [f for f in files(tmp_path) if "_staging" in f]
    own = tables.load(spark, str(tmp_path), largest=False)
    assert own.edges.count() == net.edges.count()


def test_parts_keep_the_order_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nf, "PART_ROWS", 3)
    n = 10
    net = NetworkFrame(spark.createDataFrame([("g", k, k / 7, -k / 3) for k in range(n)], NODES), spark.createDataFrame([("g", k, k + 1, None) for k in range(n - 1)], EDGES))
    nf.write_networks(net, stems(net), str(tmp_path))
    assert len([f for f in files(tmp_path) if "positions" in f]) == 4
    back = nf.read_networks(spark, str(tmp_path))
    assert not back.weighted and rows(back.nodes, "node_id", "x", "y") == rows(net.nodes, "node_id", "x", "y") and rows(back.edges, "u", "v") == rows(net.edges, "u", "v")


def test_names_are_pushed_down(spark, tmp_path):
    net = many(spark, 4)
    nf.write_networks(net, stems(net), str(tmp_path))
    nf.register(spark)
    with open(next(tmp_path.glob("run/g3_edgelist.csv/part*")), "a") as out:
        out.write("0,99,1.0\n")
    df = spark.read.format(nf.FORMAT).option("side", "edges").load(str(tmp_path))
    with pytest.raises(Exception, match="not among the 4 rows"):
        df.collect()
    assert df.where("graph_id = 'run/g0'").count() == 3
    assert df.where(F.col("graph_id").isin("run/g0", "run/g2")).where("u > 0").count() == 4
    assert df.where("graph_id = 'nowhere'").count() == 0


@pytest.mark.parametrize(("edges", "positions", "said"), [("source,target\n0,q\n", "x,y\n1,2\n", "line 2: bad number q"), ("a,b\n0,0\n", "x,y\n1,2\n", "no column"), ("source,target\n0,0\n", "x,y\n", "no positions"), ("", "x,y\n1,2\n", "empty file")])
def test_bad_files_are_refused(spark, tmp_path, edges, positions, said):
    (tmp_path / "n_edgelist.csv").write_text(edges)
    (tmp_path / "n_positions.csv").write_text(positions)
    nf.register(spark)
    with pytest.raises(Exception, match=said):
        for side in nf.SIDES:
            spark.read.format(nf.FORMAT).option("side", side).load(str(tmp_path)).collect()


def test_reader_agrees_with_the_plain_one(spark, tmp_path):
    (tmp_path / "n_EdgeList.csv").write_text("From, To ,EDGE_WEIGHT\n0,1,2.5\n\n1,0,3.5\n2.0,2,1\n")
    (tmp_path / "n_NodePositions.csv").write_text('﻿"X","y"\n1,2\n , \n3,4\n5,6\n')
    mine, plain = nf.read_networks(spark, str(tmp_path)), tables.read_pair(spark, f"{tmp_path}/n_EdgeList.csv", f"{tmp_path}/n_NodePositions.csv", "n")
    assert rows(mine.nodes, "node_id", "x", "y") == rows(plain.nodes, "node_id", "x", "y") == [(0, 2.0, 1.0), (1, 4.0, 3.0), (2, 6.0, 5.0)]
    assert rows(mine.edges, "u", "v", "weight") == rows(plain.edges, "u", "v", "weight") == [(0, 1, 3.5), (2, 2, 1.0)]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    net = many(spark, 6)
    bad = F.when((F.col("graph_id") == "g5") & (F.col("u") == 2), F.raise_error(F.lit("torn")).cast("double")).otherwise(F.col("weight"))
    torn = NetworkFrame(net.nodes, net.edges.withColumn("weight", bad), True)
    with pytest.raises(Exception, match="torn"):
        nf.write_networks(torn, stems(net), str(tmp_path))
    assert files(tmp_path) == []


def test_many_networks_are_one_write(spark, tmp_path):
    net = many(spark, 200)
    spark.sparkContext.setJobGroup("write-many", "")
    nf.write_networks(net, stems(net), str(tmp_path), ("csv", "graphml"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("write-many")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(files(tmp_path)) == 600 and len(jobs) < 12


def tailed(spark, folder, checkpoint, out):
    q = tail.log_lines(spark, str(folder)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return rows(spark.read.schema(tail.LINES).parquet(str(out)), "file", "at", "value")


def test_tail_neither_repeats_nor_loses_a_line(spark, tmp_path, monkeypatch):
    log, check, out = (tmp_path / n for n in ("log", "check", "out"))
    log.mkdir()
    a, b = log / "a.jsonl", log / "deep" / "b.jsonl"
    b.parent.mkdir()
    a.write_text("one\ntwo\nhal")
    (log / "x.txt").write_text("no log\n")
    assert [r[::2] for r in tailed(spark, log, check, out)] == [("a.jsonl", "one"), ("a.jsonl", "two")]
    with open(a, "a") as f:
        f.write("f\nthr")
    b.write_text("ü1\r\n\nlast")
    got = [r[::2] for r in tailed(spark, log, check, out)]
    assert got == [("a.jsonl", "half"), ("a.jsonl", "one"), ("a.jsonl", "two"), ("deep/b.jsonl", ""), ("deep/b.jsonl", "ü1")] or sorted(got) == sorted([("a.jsonl", "half"), ("a.jsonl", "one"), ("a.jsonl", "two"), ("deep/b.jsonl", ""), ("deep/b.jsonl", "ü1")])
    with open(a, "a") as f:
        f.write("ee\n")
    assert ("a.jsonl", 13, "three") in tailed(spark, log, check, out) and len(tailed(spark, log, check, out)) == 6
    a.write_text("")
    with pytest.raises(Exception, match="shorter"):
        tailed(spark, log, check, out)


def test_ranges_of_a_long_log(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "RANGE", 100)
    monkeypatch.setattr(tail, "BLOCK", 16)
    lines = [json.dumps({"k": i, "pad": "x" * (i * 7 % 260)}) for i in range(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\nunfinished")
    r = tail.LogReader(str(tmp_path), ".jsonl")
    end = r.latestOffset()
    parts = r.partitions({}, end)
    got = [v for p in parts for batch in r.read(p) for v in batch.column(2).to_pylist()]
    assert len(parts) > 100 and got == lines
    assert r.latestOffset() == end and r.partitions(end, end) == []


def test_tailed_log_is_parsed(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text(sinks.log_line("r1", "begun", dataset="d", percent=5.0) + "not json\n" + sinks.log_line("r1", "half", dataset="d", percent=50.0))
    q = tail.tailed(spark, str(tmp_path)).writeStream.format("memory").queryName("tailed").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("tailed"), "message", "percent") == [("begun", 5.0), ("half", 50.0)]
