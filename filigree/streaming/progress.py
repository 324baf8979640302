"""Structured Streaming over run logs and growing edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "ts timestamp, run_id string, level string, logger string, message string, tag string, dataset string, percent double, exception string"


def parsed(lines: DataFrame) -> DataFrame:
    """lines(value) of a JSONL log; malformed lines are left out."""
    return lines.select(F.from_json("value", LOG).alias("l")).where("l.run_id is not null").select("l.*")


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.readStream.text(folder))


def latest(log: DataFrame) -> DataFrame:
    """(run_id, dataset, percent): the last progress of each run; batch or stream."""
    p = log.where("percent is not null")
    return p.groupBy("run_id", "dataset").agg(F.max_by("percent", "ts").alias("percent"))


def windowed(log: DataFrame, late: str = "10 minutes", size: str = "1 minute") -> DataFrame:
    """Messages a level and minute, with late lines waited for."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "level").agg(F.count("*").alias("n")).select("w.start", "level", "n")


def percent(made, expected):
    """Share made of what is expected, in percent and at most 99 before the end."""
    return F.least(made / expected * 100, F.lit(99.0))


def degree_stream(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, degree) kept up over a stream of edges(graph_id, u, v); an extension."""
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
