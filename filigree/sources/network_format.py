"""``spatial_network``: folders of networks as a Spark format, read and written.

Reading: ``spark.read.format("spatial_network").option("side", "nodes"|"edges").load(folder)``.
A data set (a CSV pair or a GraphML file, at any depth) is one input partition,
read as a stream of Arrow batches; a filter on ``graph_id`` (=, in) is pushed down,
so that files of other data sets are not opened.  Rules and errors are those of
``tables.read_pair`` and ``tables.read_graphml``: ids by row, columns by
alias, blank rows left out, x and y exchanged in ``*_NodePositions.csv``, ends beyond the
positions refused.  ``read_networks`` reads both sides into one NetworkFrame.

Writing: rows of ``item_rows(net)``, dealt by (graph_id, part), become files of
one job.  A task writes into a staging folder; when all tasks have ended the
driver moves what the committed ones wrote into place, and a failed job leaves no file.
A CSV side of more than ``PART_ROWS`` rows is a folder of parts in order.

Paths may be of any store that Arrow's file systems reach.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .. import schema as S
from ..frame import NetworkFrame, canonical
from . import tables

FORMAT = "spatial_network"
SIDES = {"nodes": "graph_id string, node_id long, x double, y double", "edges": "graph_id string, u long, v long, weight double, edge_ix long"}
#: Rows that a network is written from: kind 0 are nodes (a, x, y), kind 1 edges (a, b, weight).
ITEMS = "graph_id string, part int, kind int, a long, b long, x double, y double, weight double, weighted boolean, stem string, form string"
FORMS = ("csv", "graphml", "graphml.gz")
PART_ROWS, BATCH_ROWS = 1_000_000, 8192


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """Arrow's file system of a path, and the path in it."""
    fs, inside = pfs.FileSystem.from_uri(path if re.match(r"^\w+:", path) else f"file://{path}")
    return fs, inside.rstrip("/")


def data_sets(folder: str) -> dict[str, tuple[str, ...]]:
    """Name inside the folder -> its files; a folder of parts is one file."""
    fs, base = file_system(folder)
    names = [x.path[len(base) + 1 :] for x in fs.get_file_info(pfs.FileSelector(base, recursive=True)) if x.is_file]
    seen = {re.sub(r"/part-[^/]*$", "", n) for n in names if "/_" not in f"/{n}" and not n.rpartition("/")[2].startswith(".")}
    return {k: tuple(f"{base}/{f}" for f in v) for k, v in tables.datasets(sorted(seen)).items()}


def _parts(fs: pfs.FileSystem, path: str) -> list[str]:
    if fs.get_file_info(path).type == pfs.FileType.Directory:
        return sorted(x.path for x in fs.get_file_info(pfs.FileSelector(path)) if x.is_file and x.base_name.startswith("part-"))
    return [path]


def csv_rows(fs: pfs.FileSystem, path: str, wanted: tuple[tuple[tuple[str, ...], bool], ...]) -> Iterator[tuple[int, list[float | None]]]:
    """(row, values) of a CSV file or a folder of its parts: numbers in the columns that the aliases name."""
    row = 0
    for part in _parts(fs, path):
        with fs.open_input_stream(part, compression=None) as raw:
            text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
            head = [c.strip().strip('"') for c in (text.readline() or "").split(",")]
            if head == [""]:
                raise ValueError(f"{path}: empty file")
            names = [tables.resolve(head, aliases, path, required) for aliases, required in wanted]
            at = [None if n is None else head.index(n) for n in names]
            for line in text:
                cells = [c.strip().strip('"') for c in line.rstrip("\r\n").split(",")]
                if not any(cells):
                    continue
                values = []
                for k in at:
                    try:
                        values.append(None if k is None else float(cells[k]))
                    except (ValueError, IndexError):
                        raise ValueError(f"{path}: line {row + 2}: bad number {cells[k] if k < len(cells) else ''}") from None
                yield row, values
                row += 1


def _graphml(fs: pfs.FileSystem, path: str) -> Iterator[tuple[str, dict, dict]]:
    """(tag, attributes, numbers by key) of a GraphML file's nodes and edges, as a stream."""
    with fs.open_input_stream(path, compression=None) as raw:
        stream = gzip.open(raw) if path.endswith(("gz", "graphmlz")) else raw
        for _, e in ElementTree.iterparse(stream):
            tag = e.tag.rpartition("}")[2]
            if tag in ("node", "edge"):
                yield tag, e.attrib, {d.get("key"): float(d.text) for d in e if d.tag.rpartition("}")[2] == "data"}
                e.clear()


def _pick(numbers: dict, *keys: str) -> float | None:
    return next((numbers[k] for k in keys if k in numbers), None)


def read_side(fs: pfs.FileSystem, name: str, files: tuple[str, ...], side: str) -> Iterator[tuple]:
    """Rows of one side of one data set."""
    if len(files) == 2:
        edges, positions = files
        where = ((S.X_ALIASES, True), (S.Y_ALIASES, True))
        if side == "nodes":
            flip, empty = positions.endswith("_NodePositions.csv"), True
            for i, (x, y) in csv_rows(fs, positions, where):
                empty = False
                yield (name, i, y, x) if flip else (name, i, x, y)
            if empty:
                raise ValueError(f"{positions}: no positions")
            return
        n = sum(1 for _ in csv_rows(fs, positions, where))
        for i, (u, v, w) in csv_rows(fs, edges, ((S.SOURCE_ALIASES, True), (S.TARGET_ALIASES, True), (S.WEIGHT_ALIASES, False))):
            if not (0 <= u < n and 0 <= v < n):
                raise ValueError(f"{edges}: node {int(v if 0 <= u < n else u)} is not among the {n} rows of {positions}")
            yield name, int(u), int(v), w, i
        return
    ids: dict[str, int] = {}
    k = 0
    for tag, at, numbers in _graphml(fs, files[0]):
        if tag == "node":
            x, y = _pick(numbers, "v_x", "x"), _pick(numbers, "v_y", "y")
            if x is None or y is None:
                raise ValueError(f"{files[0]}: a node has no x or y")
            ids[at["id"]] = len(ids)
            if side == "nodes":
                yield name, ids[at["id"]], x, y
        elif side == "edges":
            u, v = ids[at["source"]], ids[at["target"]]
            yield name, min(u, v), max(u, v), _pick(numbers, "e_weight", "weight"), k
            k += 1


@dataclass
class DataSet(InputPartition):
    name: str
    files: tuple[str, ...]


class NetworkReader(DataSourceReader):
    def __init__(self, folder: str, side: str):
        self.folder, self.side, self.names = folder, side, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of data sets are taken; all else is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("graph_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = data_sets(self.folder)
        return [DataSet(k, v) for k, v in sorted(found.items()) if self.names is None or k in self.names] or [DataSet("", ())]

    def read(self, partition: DataSet) -> Iterator[pa.RecordBatch]:
        columns = [c.split()[0] for c in SIDES[self.side].split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SIDES[self.side].split(", ")])
        if not partition.files:
            return
        fs, _ = file_system(self.folder)
        rows = read_side(fs, partition.name, partition.files, self.side)
        while held := [r for _, r in zip(range(BATCH_ROWS), rows)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(columns, zip(*held))], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    moves: tuple[tuple[str, str], ...]


class NetworkWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        fs, base = file_system(self.folder)
        here = f"{self._staging(base)}/{uuid.uuid4().hex}"
        moves = []
        for (stem, form, part), rows in groupby(iterator, key=lambda r: (r.stem, r.form, r.part)):
            for kind, side in groupby(rows, key=lambda r: r.kind) if form == "csv" else ((None, rows),):
                final = f"{stem}.{form}" if form != "csv" else f"{stem}_{'edgelist' if kind else 'positions'}.csv/part-{part:05d}.csv"
                staged = f"{here}/{final}"
                fs.create_dir(staged.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(staged, compression="gzip" if form.endswith("gz") else None) as raw, io.TextIOWrapper(raw, encoding="utf-8") as out:
                    out.writelines(csv_lines(kind, side) if form == "csv" else graphml_text(side))
                moves.append((staged, f"{base}/{final}"))
        return Written(tuple(moves))

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.folder)
        moves = [m for x in messages if x for m in x.moves]
        if not self.overwrite and (there := [t for _, t in moves if fs.get_file_info(t).type != pfs.FileType.NotFound]):
            self.abort(messages)
            raise FileExistsError(f"{there[0]} exists")
        for staged, final in moves:
            fs.create_dir(final.rpartition("/")[0], recursive=True)
            fs.move(staged, final)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.folder)
        if fs.get_file_info(self._staging(base)).type == pfs.FileType.Directory:
            fs.delete_dir(self._staging(base))


def csv_lines(kind: int, rows: Iterator) -> Iterator[str]:
    head = True
    for r in rows:
        if head:
            yield ("source_index,target_index" + ",edge_weight" * r.weighted if kind else "x,y") + "\n"
            head = False
        if r.a is None:
            continue
        yield (f"{r.a},{r.b}" + (f",{r.weight!r}" if r.weighted else "") if kind else f"{r.x!r},{r.y!r}") + "\n"


def graphml_text(rows: Iterator) -> Iterator[str]:
    head = True
    for r in rows:
        if head:
            yield '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
            yield from (f'<key id="v_{c}" for="node" attr.name="{c}" attr.type="double"/>\n' for c in "xy")
            if r.weighted:
                yield '<key id="e_weight" for="edge" attr.name="weight" attr.type="double"/>\n'
            yield '<graph id="G" edgedefault="undirected">\n'
            head = False
        if r.kind:
            yield f'<edge source="n{r.a}" target="n{r.b}">' + (f'<data key="e_weight">{r.weight!r}</data>' if r.weighted else "") + "</edge>\n"
        else:
            yield f'<node id="n{r.a}"><data key="v_x">{r.x!r}</data><data key="v_y">{r.y!r}</data></node>\n'
    yield "</graph>\n</graphml>\n"


class SpatialNetwork(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        side = self.options.get("side", "edges")
        if side not in SIDES:
            raise ValueError(f"side {side!r}; one of {', '.join(SIDES)}")
        return SIDES[side]

    def reader(self, schema) -> NetworkReader:
        return NetworkReader(self.options["path"], self.options.get("side", "edges"))

    def writer(self, schema, overwrite: bool) -> NetworkWriter:
        return NetworkWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpatialNetwork)


def read_networks(spark: SparkSession, folder: str, names: tuple[str, ...] | None = None) -> NetworkFrame:
    """All data sets of a folder, or those named; repeated pairs as tables.read_pair has them."""
    register(spark)
    side = lambda s: spark.read.format(FORMAT).option("side", s).load(folder)
    pick = lambda df: df if names is None else df.where(F.col("graph_id").isin(*names))
    edges = pick(side("edges"))
    weighted = not edges.isEmpty() and edges.where("weight is null").isEmpty()
    net = NetworkFrame(pick(side("nodes")), canonical(edges, "last", loops=True), weighted)
    return net if weighted else net.make_unweighted()


def item_rows(net: NetworkFrame, names: DataFrame, forms: tuple[str, ...] = ("csv",)) -> DataFrame:
    """ITEMS rows of networks whose names(graph_id, stem) are given; nodes are numbered by their id's order in GraphML and CSV alike."""
    if odd := [f for f in forms if f not in FORMS]:
        raise ValueError(f"unknown form {odd[0]!r}; one of {', '.join(FORMS)}")
    none = lambda kind: F.lit(None).cast(kind)
    part = lambda c: F.floor(F.col(c) / PART_ROWS).cast("int").alias("part")
    nodes = net.nodes.select("graph_id", part("node_id"), F.lit(0).alias("kind"), F.col("node_id").alias("a"), none("long").alias("b"), "x", "y", none("double").alias("weight"))
    edges = net.edges.select("graph_id", part("u"), F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), none("double").alias("x"), none("double").alias("y"), "weight")
    # A network without edges still has an edge list: a row without ends is a heading.
    heads = names.select("graph_id", F.lit(0).alias("part"), F.lit(1).alias("kind"), none("long").alias("a"), none("long").alias("b"), *(none("double").alias(c) for c in ("x", "y", "weight")))
    rows = nodes.unionByName(edges).unionByName(heads).withColumn("weighted", F.lit(net.weighted)).join(names.select("graph_id", "stem"), "graph_id")
    rows = rows.withColumn("form", F.explode(F.array(*map(F.lit, forms)))).where("a is not null or form = 'csv'")
    return rows.withColumn("part", F.when(F.col("form") == "csv", F.col("part")).otherwise(0)).select(*(c.split()[0] for c in ITEMS.split(", ")))


def write_networks(net: NetworkFrame, names: DataFrame, folder: str, forms: tuple[str, ...] = ("csv",)) -> None:
    """All networks in all forms by one job; names(graph_id, stem) say where each stands under the folder."""
    register(net.nodes.sparkSession)
    rows = item_rows(net, names, forms)
    # A CSV side has an order of its own; GraphML wants all nodes before the edges.
    dealt = rows.repartition("stem", "form", "part").sortWithinPartitions("stem", "form", "part", "kind", "a", "b")
    dealt.write.format(FORMAT).mode("overwrite").save(folder)
