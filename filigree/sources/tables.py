"""Networks from text files: CSV pairs, GraphML, coordinate triples; and directories of them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..frame import NetworkFrame, canonical, from_matrix
from ..operators.components import largest_component

GRAPHML_NODE = "_id string, data array<struct<_key:string,_VALUE:string>>"
GRAPHML_EDGE = "_source string, _target string, data array<struct<_key:string,_VALUE:string>>"
GRAPHML_SUFFIXES = (".graphml", ".graphml.gz", ".graphmlz")
#: Suffixes of edge list and positions, of a pair (fixed values), in order of preference.
PAIR_FORMS = (("_edgelist.csv", "_positions.csv"), ("_EdgeList.csv", "_NodePositions.csv"))


def resolve(columns: Iterable[str], aliases: tuple[str, ...], path: str, required: bool = True) -> str | None:
    """The column that an alias names, trimmed and in any case; the first alias wins."""
    have = {c.strip().lower(): c for c in reversed(list(columns))}
    found = next((have[a] for a in aliases if a in have), None)
    if found is None and required:
        raise ValueError(f"{path}: no column {' / '.join(aliases)} among {', '.join(columns) or 'none'}")
    return found


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text with ``row_no``, 0-based in file order; rows of blank cells are left out.

    One file is one network's side, so its order is its partitions' order.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not df.columns:
        raise ValueError(f"{path}: empty file")
    some = F.exists(F.array(*(F.col(f"`{c}`") for c in df.columns)), lambda c: F.trim(c) != "")
    df = df.where(some).withColumn("_at", F.monotonically_increasing_id())
    return df.withColumn("row_no", F.row_number().over(Window.orderBy("_at")).cast("long") - 1).drop("_at")


def number(column: str, path: str, kind: str):
    c = F.col(f"`{column}`")
    value = c.try_cast("double")
    bad = F.raise_error(F.concat(F.lit(f"{path}: line "), (F.col("row_no") + 2).cast("string"), F.lit(": bad number "), F.coalesce(c, F.lit(""))))
    return F.when(value.isNull(), bad.cast(kind)).otherwise(value.cast(kind))


def read_positions(spark: SparkSession, path: str, graph_id: str = "g") -> DataFrame:
    """(graph_id, node_id, x, y); a node's id is its row. A file without rows is an error."""
    df = read_rows(spark, path)
    x, y = (resolve(df.columns, a, path) for a in (S.X_ALIASES, S.Y_ALIASES))
    out = df.select(F.lit(graph_id).alias("graph_id"), F.col("row_no").alias("node_id"), number(x, path, "double").alias("x"), number(y, path, "double").alias("y"))
    if df.isEmpty():
        raise ValueError(f"{path}: no positions")
    return out


def read_edge_list(spark: SparkSession, path: str, graph_id: str = "g") -> tuple[DataFrame, bool]:
    """((graph_id, u, v, weight, edge_ix), weighted); ids like 3.0 are cut to whole numbers."""
    df = read_rows(spark, path)
    u, v = (resolve(df.columns, a, path) for a in (S.SOURCE_ALIASES, S.TARGET_ALIASES))
    w = resolve(df.columns, S.WEIGHT_ALIASES, path, required=False)
    weight = number(w, path, "double") if w else F.lit(None).cast("double")
    return df.select(F.lit(graph_id).alias("graph_id"), number(u, path, "long").alias("u"), number(v, path, "long").alias("v"), weight.alias("weight"), F.col("row_no").alias("edge_ix")), w is not None


def read_pair(spark: SparkSession, edges_path: str, positions_path: str, graph_id: str = "g", largest: bool = False) -> NetworkFrame:
    """A CSV pair: loops stay, pairs once with the last row's weight; ends beyond the positions are an error.

    Positions named ``*_NodePositions.csv`` have x and y exchanged.
    """
    nodes = read_positions(spark, positions_path, graph_id)
    edges, weighted = read_edge_list(spark, edges_path, graph_id)
    if positions_path.endswith("_NodePositions.csv"):
        nodes = nodes.select("graph_id", "node_id", F.col("y").alias("x"), F.col("x").alias("y"))
    worst = edges.agg(F.min(F.least("u", "v")).alias("lo"), F.max(F.greatest("u", "v")).alias("hi")).first()
    n = nodes.count()
    if worst["hi"] is not None and (worst["lo"] < 0 or worst["hi"] >= n):
        raise ValueError(f"{edges_path}: node {worst['hi'] if worst['hi'] >= n else worst['lo']} is not among the {n} rows of {positions_path}")
    e = canonical(edges, "last", loops=True) if weighted else canonical(edges, "any", loops=True)
    net = NetworkFrame(nodes, e, weighted).checked()
    return largest_component(net, renumber=True) if largest else net


def read_graphml(spark: SparkSession, path: str, graph_id: str = "g", largest: bool = False) -> NetworkFrame:
    """GraphML, plain or gzip: x and y of every node, weight if edges have one; edges as stored, repeated ones too."""
    pick = lambda key: F.get(F.filter("data", lambda d: d["_key"].isin(*key)), 0)["_VALUE"].cast("double")
    xml = lambda tag, ddl: spark.read.format("xml").option("rowTag", tag).schema(ddl).load(path)
    at = F.monotonically_increasing_id()
    nodes = xml("node", GRAPHML_NODE).withColumn("_at", at)
    nodes = nodes.select(F.lit(graph_id).alias("graph_id"), "_id", (F.row_number().over(Window.orderBy("_at")).cast("long") - 1).alias("node_id"), pick(("v_x", "x")).alias("x"), pick(("v_y", "y")).alias("y"))
    missing = F.raise_error(F.lit(f"{path}: a node has no x or y"))
    nodes = nodes.withColumns({c: F.when(F.col(c).isNull(), missing.cast("double")).otherwise(F.col(c)) for c in ("x", "y")})
    ids = nodes.select("_id", "node_id")
    raw = xml("edge", GRAPHML_EDGE).withColumn("weight", pick(("e_weight", "weight")))
    e = raw.join(ids.select(F.col("_id").alias("_source"), F.col("node_id").alias("u")), "_source").join(ids.select(F.col("_id").alias("_target"), F.col("node_id").alias("v")), "_target")
    e = e.select(F.lit(graph_id).alias("graph_id"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight")
    weighted = not e.where("weight is not null").isEmpty()
    net = NetworkFrame(nodes.drop("_id"), e, weighted).checked()
    return largest_component(net, renumber=True) if largest else net


def from_triples(nodes: DataFrame, cells: DataFrame, transpose: bool = True) -> NetworkFrame:
    """Coordinate triples cells(graph_id, row, col, value) and positions in (row, column) order; largest component."""
    flip = nodes.select("graph_id", "node_id", F.col("y").alias("x"), F.col("x").alias("y")) if transpose else nodes
    order = F.struct("row", "col")
    e = cells.where("value <> 0").select("graph_id", F.col("row").cast("long").alias("u"), F.col("col").cast("long").alias("v"), F.col("value").alias("weight"), order.alias("edge_ix"))
    return largest_component(from_matrix(flip, e), renumber=True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Files under a folder of any store that Spark's file systems reach; a folder of parts is one file."""
    from .sinks import outputs

    return [f"{folder.rstrip('/')}/{f}" for f in outputs(spark, folder)]


def datasets(paths: list[str]) -> dict[str, tuple[str, ...]]:
    """Prefix -> files of the datasets among paths; a repeated prefix or a missing partner is an error."""
    found: dict[str, tuple[str, ...]] = {}
    have = set(paths)

    def add(prefix: str, files: tuple[str, ...]) -> None:
        if prefix in found:
            raise ValueError(f"dataset {prefix} stands in more than one form")
        found[prefix] = files

    for path in sorted(paths):
        for lead, partner in PAIR_FORMS:
            if path.endswith(lead):
                other = path[: -len(lead)] + partner
                if other not in have:
                    raise ValueError(f"{path} has no {other}")
                add(path[: -len(lead)], (path, other))
        for suffix in GRAPHML_SUFFIXES:
            if path.endswith(suffix):
                add(path[: -len(suffix)], (path,))
    return found


def _owners(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(file, graph_id): whose file each path is, as Spark names it; one row a file."""
    conf = spark._jsc.hadoopConfiguration()

    def named(path: str) -> str:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return re.sub("^file:/+", "file:/", p.getFileSystem(conf).makeQualified(p).toUri().toString())

    return spark.createDataFrame([(named(path), graph) for graph, path in files.items()], "file string, graph_id string")


def _owned(df: DataFrame, owners: DataFrame) -> DataFrame:
    """df with ``graph_id`` by the file that a row is from (a folder of parts is a file) and ``_at``, its place there."""
    df = df.select("*", F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", ""), "^file:/+", "file:/").alias("file"), F.monotonically_increasing_id().alias("_at"))
    return df.join(F.broadcast(owners), "file")


def _cells(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(graph_id, file, head, cells, row_no) of many small CSV files in one scan; rows of blank cells are left out."""
    lines = _owned(spark.read.text(list(files.values())), _owners(spark, files))
    cells = F.transform(F.split("value", ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    rows = lines.select("graph_id", "file", "_at", cells.alias("cells")).where(F.exists("cells", lambda c: F.trim(c) != ""))
    w = Window.partitionBy("graph_id").orderBy("_at")
    rows = rows.withColumns({"row_no": F.row_number().over(w).cast("long") - 2, "head": F.first("cells").over(w)})
    return rows.where("row_no >= 0").withColumn("head", F.transform("head", lambda c: F.lower(F.trim(c))))


def _cell(aliases: tuple[str, ...], kind: str, required: bool = True):
    """The number in the column that an alias names; the first alias wins."""
    at = F.coalesce(*(F.when(F.array_position("head", a) > 0, F.array_position("head", a)) for a in aliases)).cast("int")
    text = F.get("cells", at - 1)
    none = F.raise_error(F.concat("file", F.lit(f": no column {' / '.join(aliases)}"))).cast(kind) if required else F.lit(None).cast(kind)
    bad = F.raise_error(F.concat(F.col("file"), F.lit(": line "), (F.col("row_no") + 2).cast("string"), F.lit(": bad number "), F.coalesce(text, F.lit("")))).cast(kind)
    value = text.try_cast("double")
    return F.when(at.isNull(), none).when(value.isNull(), bad).otherwise(value.cast(kind))


def read_pairs(spark: SparkSession, files: dict[str, tuple[str, str]]) -> NetworkFrame:
    """Many CSV pairs (edges, positions) as one frame, by one scan of each side; the rules are read_pair's."""
    at = _cells(spark, {g: p for g, (_, p) in files.items()})
    x, y = _cell(S.X_ALIASES, "double"), _cell(S.Y_ALIASES, "double")
    flip = F.col("file").endswith("_NodePositions.csv")
    nodes = at.select("graph_id", F.col("row_no").alias("node_id"), F.when(flip, y).otherwise(x).alias("x"), F.when(flip, x).otherwise(y).alias("y"))
    lines = _cells(spark, {g: e for g, (e, _) in files.items()})
    edges = lines.select("graph_id", _cell(S.SOURCE_ALIASES, "long").alias("u"), _cell(S.TARGET_ALIASES, "long").alias("v"), _cell(S.WEIGHT_ALIASES, "double", False).alias("weight"), F.col("row_no").alias("edge_ix"))
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    checked = edges.join(n, "graph_id", "left")
    inside = (F.least("u", "v") >= 0) & (F.greatest("u", "v") < F.coalesce("n", F.lit(0)))
    missing = F.raise_error(F.concat("graph_id", F.lit(": an edge's node is not among the positions"))).cast("long")
    edges = checked.withColumn("u", F.when(inside, F.col("u")).otherwise(missing)).drop("n")
    weighted = lines.where(~F.arrays_overlap("head", F.array(*map(F.lit, S.WEIGHT_ALIASES)))).isEmpty() and not lines.isEmpty()
    net = NetworkFrame(nodes, canonical(edges, "last", loops=True), weighted)
    return net.checked() if weighted else net.make_unweighted()


def read_graphmls(spark: SparkSession, files: dict[str, str]) -> NetworkFrame:
    """Many GraphML files as one frame, by one scan of their nodes and one of their edges."""
    owners = _owners(spark, files)
    pick = lambda key: F.get(F.filter("data", lambda d: d["_key"].isin(*key)), 0)["_VALUE"].cast("double")
    xml = lambda tag, ddl: _owned(spark.read.format("xml").option("rowTag", tag).schema(ddl).load(list(files.values())), owners)
    nodes = xml("node", GRAPHML_NODE)
    missing = F.raise_error(F.concat("file", F.lit(": a node has no x or y"))).cast("double")
    where = {c: F.coalesce(pick((f"v_{c}", c)), missing) for c in "xy"}
    row = F.row_number().over(Window.partitionBy("graph_id").orderBy("_at")).cast("long") - 1
    nodes = nodes.select("graph_id", "_id", row.alias("node_id"), where["x"].alias("x"), where["y"].alias("y"))
    end = lambda key, name: nodes.select("graph_id", F.col("_id").alias(key), F.col("node_id").alias(name))
    raw = xml("edge", GRAPHML_EDGE).withColumn("weight", pick(("e_weight", "weight")))
    e = raw.join(end("_source", "u"), ["graph_id", "_source"]).join(end("_target", "v"), ["graph_id", "_target"])
    e = e.select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight")
    per = e.groupBy("graph_id").agg(F.count("weight").alias("n"))
    weighted = per.where("n = 0").isEmpty() and not per.isEmpty()
    net = NetworkFrame(nodes.drop("_id"), e, weighted)
    return net.checked() if weighted else replace(net, edges=e.withColumn("weight", F.lit(None).cast("double")))


def first_network(net: NetworkFrame) -> NetworkFrame:
    """The network with the smallest name alone, where a file must hold one."""
    first = net.nodes.agg(F.min("graph_id").alias("graph_id"))
    return replace(net, nodes=net.nodes.join(F.broadcast(first), "graph_id"), edges=net.edges.join(F.broadcast(first), "graph_id"))  # one row


def load_set(spark: SparkSession, files: dict[str, tuple[str, ...]], largest: bool = True) -> NetworkFrame:
    """Many datasets as one frame, graph_id being the dataset's name; GraphML files if there are any, else CSV pairs.

    However many they are, a side is one scan; the set is weighted if all of its networks are.
    """
    if not files:
        raise ValueError("no networks found")
    xml = {k: v[0] for k, v in files.items() if len(v) == 1}
    net = read_graphmls(spark, xml) if xml else read_pairs(spark, files)
    return largest_component(net, renumber=True) if largest else net


def load(spark: SparkSession, path: str, largest: bool = True) -> NetworkFrame:
    """A GraphML file, an edge list with its positions, or a folder of either."""
    if path.endswith(GRAPHML_SUFFIXES):
        return read_graphml(spark, path, path, largest)
    for lead, partner in PAIR_FORMS:
        if path.endswith(lead):
            return read_pair(spark, path, path[: -len(lead)] + partner, path, largest)
    if path.endswith((".pkl", ".npy", ".csv")):
        raise ValueError(f"{path}: not a network file that can be read")
    return load_set(spark, datasets(listed(spark, path)), largest)


def frame_of(net: NetworkFrame, longest: float | None = None) -> DataFrame:
    """(graph_id, width, height): the extent rounded up, at least 1; ``longest`` scales its longer side."""
    box = net.nodes.groupBy("graph_id").agg(F.greatest(F.ceil(F.max("x")), F.lit(1)).cast("double").alias("width"), F.greatest(F.ceil(F.max("y")), F.lit(1)).cast("double").alias("height"))
    if longest is None:
        return box
    scale = F.lit(float(longest)) / F.greatest("width", "height")
    return box.select("graph_id", F.greatest(F.ceil(F.col("width") * scale), F.lit(1)).cast("double").alias("width"), F.greatest(F.ceil(F.col("height") * scale), F.lit(1)).cast("double").alias("height"))


def resized(side: tuple[int, int], target: tuple[int, int]) -> tuple[int, int]:
    """Size of a picture whose longer side becomes the target's longer one."""
    scale = max(target) / max(side)
    return max(1, round(side[0] * scale)), max(1, round(side[1] * scale))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """A sweep's results: a JSON array of [node_factor, edge_factor, error, success_rate]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<double>>")).alias("r"))
    return rows.select(*(F.get("r", i).alias(c) for i, c in enumerate(("node_factor", "edge_factor", "error", "success_rate"))))


def write_trials(trials: DataFrame, path: str) -> None:
    """The same form, one array; a sweep's trials are a grid that its caller sets."""
    row = F.array("node_factor", "edge_factor", "error", "success_rate")
    rows = trials.agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def snapshot_pairs(files: DataFrame) -> DataFrame:
    """files(path) -> (snapshot_ix, positions, edges): snapshots that have both, by number."""
    at = lambda kind: files.select(F.regexp_extract("path", rf"snapshot_(\d+)_{kind}\.\w+$", 1).alias("n"), F.col("path").alias(kind)).where("n <> ''")
    return at("positions").join(at("edges"), "n").select(F.col("n").cast("int").alias("snapshot_ix"), "positions", "edges").orderBy("snapshot_ix")


def snapshot_networks(spark: SparkSession, path: str, largest: bool = False) -> NetworkFrame:
    """Snapshots that sinks.write_snapshots wrote, as networks ``snapshot_<number>``; an end is a node's id in its own snapshot."""
    rows = spark.read.parquet(path).select(F.format_string("snapshot_%05d", "snapshot_ix").alias("graph_id"), "nodes", "edges")
    nodes = rows.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.node_id", "n.x", "n.y")
    edges = rows.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.u", "e.v", "e.weight")
    net = NetworkFrame(nodes, edges, not edges.isEmpty() and edges.where("weight is null").isEmpty())
    return largest_component(net, renumber=True) if largest else net


def load_named(spark: SparkSession, paths: list[str], name: str) -> NetworkFrame:
    """The data set ``name`` among paths: CSV pair first, then compressed GraphML, then plain."""
    have = set(paths)
    for lead, partner in PAIR_FORMS:
        hit = next((p for p in have if p.endswith(f"/{name}{lead}")), None)
        if hit and hit[: -len(lead)] + partner in have:
            return read_pair(spark, hit, hit[: -len(lead)] + partner, name, largest=True)
    for suffix in (".graphml.gz", ".graphmlz", ".graphml"):
        hit = next((p for p in sorted(have) if p.endswith(f"/{name}{suffix}")), None)
        if hit:
            return read_graphml(spark, hit, name, largest=True)
    raise ValueError(f"no network {name}")
