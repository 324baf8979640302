"""Writing networks, reports, manifests and run logs."""

from __future__ import annotations

import json
import os
import re
import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NetworkFrame

MANIFEST_VERSION = 1
#: Shares under this are shown as less than 0.1 % (fixed value).
LEAST_SHOWN = 0.0005


def write_pair(net: NetworkFrame, prefix: str) -> None:
    """``prefix_edgelist.csv`` and ``prefix_positions.csv`` (folders of one part each) of one network."""
    e = net.edges.orderBy("u", "v").select(F.col("u").alias("source_index"), F.col("v").alias("target_index"), *([F.col("weight").alias("edge_weight")] if net.weighted else []))
    e.coalesce(1).write.mode("overwrite").csv(f"{prefix}_edgelist.csv", header=True)
    net.nodes.orderBy("node_id").select("x", "y").coalesce(1).write.mode("overwrite").csv(f"{prefix}_positions.csv", header=True)


def graphml_lines(net: NetworkFrame) -> DataFrame:
    """(part, at, line) of one network's GraphML."""
    spark = net.nodes.sparkSession
    weight = '<data key="e_weight">%s</data>' if net.weighted else ""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="v_{c}" for="node" attr.name="{c}" attr.type="double"/>' for c in "xy")]
    head += ['<key id="e_weight" for="edge" attr.name="weight" attr.type="double"/>'] * net.weighted + ['<graph id="G" edgedefault="undirected">']
    text = lambda c: F.col(c).cast("string")
    nodes = net.nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("at"), F.format_string('<node id="n%s"><data key="v_x">%s</data><data key="v_y">%s</data></node>', text("node_id"), text("x"), text("y")).alias("line"))
    args = [text("u"), text("v")] + [text("weight")] * net.weighted
    edges = net.edges.select(F.lit(2).alias("part"), (F.col("u") * F.lit(1 << 32) + F.col("v")).alias("at"), F.format_string('<edge source="n%s" target="n%s">' + weight + "</edge>", *args).alias("line"))
    ends = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "part int, at long, line string")
    return ends.unionByName(nodes).unionByName(edges).orderBy("part", "at")


def write_graphml(net: NetworkFrame, path: str, gzip: bool = False) -> None:
    w = graphml_lines(net).select("line").coalesce(1).write.mode("overwrite")
    (w.option("compression", "gzip") if gzip else w).text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, keys in order."""
    df.select(*sorted(df.columns)).coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """(snapshot_ix, ...) as Parquet by snapshot."""
    snapshots.write.mode("append").partitionBy("snapshot_ix").parquet(path)


def named(prefix: str, detail: str, extension: str, stamp: str | None = None) -> str:
    return f"{prefix}{detail}{'_' + stamp if stamp else ''}.{extension}"


def stamp(now: float | None = None) -> str:
    return datetime.fromtimestamp(time.time() if now is None else now, UTC).strftime("%Y%m%d_%H%M%S")


def run_root(base: str, denote: str, run_id: str, now: float | None = None) -> str:
    return f"{base}/{denote}_results_{stamp(now)}_{run_id}"


def link_latest(base: str, root: str) -> None:
    """``latest_result`` beside local runs."""
    link = os.path.join(base, "latest_result")
    if os.path.islink(link):
        os.unlink(link)
    os.symlink(os.path.basename(root), link)


#: Kinds of output files by the lower-cased path inside the run, the first that fits (fixed values).
KINDS = (
    ("edge_lists", r"_edgelist\.csv$"),
    ("snapshots", r"(^|/)snapshots(/|$)"),
    ("positions", r"_positions\.(csv|npy)$"),
    ("analysis", r"analysis"),
    ("previews", r"\.(webp|png|svg|jpg|jpeg|tif|tiff)$"),
    ("networks", r"\.(graphml|graphml\.gz|graphmlz)$"),
)
OTHER = "other"
STATUS_OK, STATUS_FAILED, STATUS_CANCELLED = "ok", "failed", "cancelled"
MANIFEST_NAME = "manifest.json"


def classify(path: Column) -> Column:
    """Kind of an output file by its path inside the run; the first rule that fits."""
    low = F.lower(path)
    out = F.lit(OTHER)
    for kind, pattern in reversed(KINDS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def manifest(paths: DataFrame, root: str, status: str = STATUS_OK, error: str | None = None) -> DataFrame:
    """paths(path) -> one row: version, status, root, outputs by kind (sorted), count, error; without the manifest itself."""
    inside = F.when(F.startswith("path", F.lit(f"{root}/")), F.substr("path", F.lit(len(root) + 2))).otherwise(F.col("path"))
    p = paths.where(F.element_at(F.split("path", "/"), -1) != MANIFEST_NAME).select(inside.alias("path"))
    kinds = p.groupBy(classify(F.col("path")).alias("kind")).agg(F.array_sort(F.collect_list("path")).alias("files"))
    out = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "files")))).alias("outputs"), F.coalesce(F.sum(F.size("files")), F.lit(0)).cast("int").alias("file_count"))
    return out.select(F.lit(MANIFEST_VERSION).alias("manifest_version"), F.lit(status).alias("status"), F.lit(root).alias("run_root"), "outputs", "file_count", F.lit(error).cast("string").alias("error"))


def listed(spark: SparkSession, root: str) -> list[str]:
    """All files under a folder of any store that Spark's file systems reach, as paths inside it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(path).toString().rstrip("/")
    out, files = [], fs.listFiles(path, True)
    while files.hasNext():
        out.append(files.next().getPath().toString()[len(base) + 1 :])
    return sorted(out)


def outputs(spark: SparkSession, root: str) -> list[str]:
    """``listed`` without markers and hidden files; a table is a folder of parts and counts as the one file that it stands for."""
    names = (f for f in listed(spark, root) if "/_" not in f"/{f}" and not f.rpartition("/")[2].startswith("."))
    return sorted({re.sub(r"/part-[^/]*$", "", f) for f in names})


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _put(spark, path, text)


def write_manifest(spark: SparkSession, root: str, status: str = STATUS_OK, error: str | None = None, metrics: dict | None = None) -> dict:
    """Lists a run folder and writes its manifest.json, whatever the status; ``error`` and ``metrics`` stand in it only where given."""
    row = manifest(spark.createDataFrame([(f,) for f in outputs(spark, root)], "path string"), root, status, error).first().asDict(recursive=True)
    if not error:
        del row["error"]
    if metrics:
        row["metrics"] = metrics
    _put(spark, f"{root}/{MANIFEST_NAME}", json.dumps(row, sort_keys=True, indent=2))
    return row


def read_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/{MANIFEST_NAME}", wholetext=True).first()[0])


def log_line(run_id: str, message: str, level: str = "INFO", logger: str = "filigree", now: datetime | None = None, **extra) -> str:
    """One JSON object and a line end; tag, dataset, percent and exception stand at the top level."""
    row = {"ts": (now or datetime.now(UTC)).isoformat(), "run_id": run_id, "level": level, "logger": logger, "message": message}
    row |= {k: v for k, v in extra.items() if k in ("tag", "dataset", "percent", "exception") and v is not None}
    return json.dumps(row) + "\n"


class RunLog:
    """One JSON object a line; tag, dataset and percent stand at the top level."""

    def __init__(self, path: str, run_id: str):
        self.path, self.run_id = path, run_id

    def write(self, message: str, level: str = "INFO", logger: str = "filigree", **extra) -> None:
        with open(self.path, "a") as out:
            out.write(log_line(self.run_id, message, level, logger, **extra))


def export_order(paths: DataFrame) -> DataFrame:
    """paths(path) with ``generation``, the number in ``_n<number>_``, in its order; paths without one last."""
    n = F.regexp_extract("path", r"_n(\d+)_", 1)
    return paths.withColumn("generation", F.when(n != "", n.cast("long"))).orderBy(F.col("generation").asc_nulls_last(), "path")


def preview(shares: DataFrame) -> DataFrame:
    """(graph_id, degree, share) of a degree distribution -> label in percent and bar length over the largest share."""
    top = shares.groupBy("graph_id").agg(F.max("share").alias("top"))
    bar = F.when(F.col("top") > 0, F.col("share") / F.col("top")).otherwise(0.0)
    label = F.when((F.col("share") > 0) & (F.col("share") < LEAST_SHOWN), "<0.1%").otherwise(F.format_string("%.1f%%", 100 * F.col("share")))
    return shares.join(top, "graph_id").select("graph_id", "degree", label.alias("label"), bar.alias("bar"))


def preview_metrics(counts: DataFrame, attributes: DataFrame, shares: DataFrame) -> DataFrame:
    """(graph_id, metrics): what a preview shows of a network, as JSON: cells of labels and values, and the degree bars."""
    cells = F.array(
        F.lit("Nodes"), F.format_string("%,d", "node_count"), F.lit("Edges"), F.format_string("%,d", "edge_count"),
        F.lit("Average degree"), F.format_string("%.4f", "average_degree"), F.lit("Average edge length"), F.format_string("%.4f", "average_length"),
    )
    bars = preview(shares).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("degree").cast("long").alias("at"), F.col("label").alias("percent"), "bar"))).alias("bars"))
    rows = F.transform(F.coalesce("bars", F.array().cast("array<struct<at:bigint,percent:string,bar:double>>")), lambda b: F.struct(b["at"].cast("string").alias("degree"), b.percent.alias("percent"), b.bar.alias("bar")))
    j = counts.join(attributes.select("graph_id", "average_degree", "average_length"), "graph_id").join(bars, "graph_id", "left")
    return j.select("graph_id", F.to_json(F.struct(cells.alias("cells"), rows.alias("distribution"))).alias("metrics"))


def report_lines(counts: DataFrame, attributes: DataFrame) -> DataFrame:
    """(graph_id, line): counts, averages and the degree distribution as text."""
    j = counts.join(attributes, "graph_id")
    dist = F.transform(F.array_sort(F.map_entries("degree_distribution")), lambda e: F.format_string("  degree %d: %.4f", e.key, e.value))
    head = F.array(
        F.format_string("nodes: %,d", "node_count"), F.format_string("edges: %,d", "edge_count"),
        F.format_string("average length: %.4f", "average_length"), F.format_string("average degree: %.4f", "average_degree"), F.lit("degree distribution:"),
    )
    return j.select("graph_id", F.explode(F.concat(head, dist)).alias("line"))
