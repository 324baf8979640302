"""Runs from a configuration: every data set in turn, outputs into one folder, a manifest whatever happens."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import NetworkFrame
from ..operators import growth as Gr
from ..operators import ranking as R
from ..operators import topology as T
from ..sources import network_format, sinks, spec, tables
from . import pipelines as P

Source = Callable[[SparkSession, str], NetworkFrame]
#: Folders of a run (fixed values).
ORIGINAL, SYNTHETIC = "original", "synthetic"


def source_of(inputs: dict) -> Source:
    """How a data set's network is read; a run may be given another one."""

    def read(spark: SparkSession, dataset: str) -> NetworkFrame:
        if inputs.get("datasets_dir"):
            folder = inputs["datasets_dir"].rstrip("/")
            return tables.load_named(spark, [f"{folder}/{f}" for f in sinks.outputs(spark, folder)], dataset)
        if inputs.get("network_graphml"):
            return tables.read_graphml(spark, inputs["network_graphml"], dataset, largest=True)
        if inputs.get("adjacency"):
            nodes = spark.read.parquet(inputs["positions_npy"])
            return tables.from_triples(nodes, spark.read.parquet(inputs["adjacency"]))
        return tables.read_pair(spark, inputs["edge_list"], inputs["positions"], dataset, largest=True)

    return read


class Cancelled(Exception):
    """A run was asked to end."""


class Run:
    """One run's folder, log and outputs; ``stop`` is looked at before whatever is read, said or written."""

    def __init__(self, spark: SparkSession, config, source: Source, now: float | None = None, stop: threading.Event | None = None):
        self.spark, self.config, self.source, self.stop = spark, config, source, stop or threading.Event()
        self.root = sinks.run_root(config.output_dir, config.denote or spec.MODE_OF[type(config)], config.run_id, now)
        self.log: list[str] = []
        self.metrics: dict = {}

    def go_on(self) -> None:
        if self.stop.is_set():
            raise Cancelled

    def say(self, message: str, **extra) -> None:
        self.go_on()
        self.log.append(sinks.log_line(self.config.run_id, message, **extra))

    def save(self, what, dataset: str, folder: str, detail: str, extension: str, prefix: str = "", stamp: str | None = None) -> None:
        """``what`` under root/dataset/folder by its form: a network, a text, a table, or anything JSON can hold."""
        self.go_on()
        if self.config.disable_saving or what is None:
            return
        path = "/".join(x for x in (self.root, dataset, folder, sinks.named(prefix, detail, extension, stamp)) if x)
        if isinstance(what, NetworkFrame):
            if extension == "csv":
                sinks.write_pair(what, path.removesuffix(".csv"))
            else:
                sinks.write_graphml(what, path, gzip=extension.endswith("gz"))
        elif isinstance(what, DataFrame):
            (sinks.write_json if extension == "json" else sinks.write_csv)(what, path)
        elif isinstance(what, str):
            sinks.write_text(self.spark, path, what)
        else:
            sinks.write_text(self.spark, path, json.dumps(what, sort_keys=True, indent=2))

    def as_measured(self, net: NetworkFrame) -> NetworkFrame:
        """With the weights that the run asks for: none, all (1.0 where there are none), or the stored ones."""
        want = self.config.measure_weighted
        return net if want is None else net.make_weighted() if want else net.make_unweighted()

    def original(self, dataset: str) -> NetworkFrame:
        net = T.oriented(self.as_measured(self.source(self.spark, dataset)), self.config.orientation)
        return P.kept(net)

    def save_original(self, dataset: str, net: NetworkFrame) -> Gr.Sample:
        """The network, what was measured on it, and its report; returns what growth draws from."""
        stamp = sinks.stamp()
        for extension in self.config.network_formats:
            self.save(net, dataset, ORIGINAL, "original_network", extension, stamp=stamp)
        attributes = P.cut(T.attributes(net, Gr.MOST_VALUES), "attributes")
        row = attributes.first()
        self.save({k: v for k, v in row.asDict(recursive=True).items() if k != "graph_id"}, dataset, ORIGINAL, "original_property", "json", stamp=stamp)
        self.save(report("Original Network", net, attributes), dataset, ORIGINAL, "report", "txt")
        return Gr.Sample.of_row(row)

    def save_networks(self, dataset: str, got: DataFrame, weighted: bool, prefix: str) -> None:
        """Every accepted network under its number in order of candidate, all of them and all forms by one job."""
        if self.config.disable_saving:
            return
        order = Window.orderBy("candidate_id", "graph_id")  # one row a network
        name = F.concat(F.lit(f"{dataset}/{SYNTHETIC}/{prefix}_n"), (F.row_number().over(order) - 1).cast("string"), F.lit(f"_synthetic_network_{sinks.stamp()}"))
        names = got.select("candidate_id", P.graph_id()).select("graph_id", name.alias("stem"))
        network_format.write_networks(P.grown_frame(got, weighted), names, self.root, self.config.network_formats)

    def params(self, net: NetworkFrame, node_factor: float = 1.0, edge_factor: float = 1.0) -> tuple[Gr.Params, tuple[float, float]]:
        """(growth parameters in the synthetic frame, the original's frame)."""
        c = self.config
        if c.frame:
            frame = tuple(c.frame)
        else:
            box = tables.frame_of(net).first()
            frame = box.width, box.height
        width, height = c.synthetic_frame or frame
        return Gr.Params(node_factor, edge_factor, float(width), float(height), c.seed), frame


def report(title: str, net: NetworkFrame, attributes: DataFrame) -> str:
    lines = [r.line for r in sinks.report_lines(T.counts(net), attributes).collect()]
    return "\n".join([title, *lines, ""])


def generate(run: Run, dataset: str) -> None:
    c = run.config
    net = run.original(dataset)
    sample = run.save_original(dataset, net)
    params, _ = run.params(net, c.node_factor, c.edge_factor)
    if not c.select_best and c.every > 0:
        snapshot_run(run, dataset, net, sample, params)
        return
    if c.count <= 0:
        run.say("no synthetic networks are asked for", dataset=dataset)
        return
    # With snapshots a candidate is judged once when it has as many nodes as the original; without a gate there is nothing to judge.
    early = T.counts(net).first()["node_count"] if c.select_best and c.every and c.error_checker != "none" else 0
    got, mean = P.generate(run.spark, net, params, c.count, c.error_checker, c.error_tolerance, c.max_attempts, c.full_q_band, early, max(1, c.every))
    if not c.select_best:
        row = mean.first()
        n = got.count()
        run.save_networks(dataset, got, net.weighted, f"len_{n}_err_{row.error if row else float('inf'):.3f}")
        run.say(f"{n} of {c.count} networks passed", dataset=dataset, percent=100.0)
        return
    errors = got.select(P.graph_id(), "error")
    measured = P.cut(T.metrics(P.grown_frame(got, net.weighted)), "metrics")
    ranked = P.cut(R.ranked(measured, T.metrics(net), c.select_best), "ranked")
    best = got.withColumn("graph_id", P.graph_id()).join(ranked.select("graph_id", "rank"), "graph_id")
    # The best ones are numbered by rank.
    best = best.withColumn("candidate_id", F.col("rank").cast("long")).drop("graph_id", "rank")
    n = ranked.count()
    run.save_networks(dataset, best, net.weighted, f"best{n}_of_{got.count()}")
    run.save(R.ranking_report(measured, T.metrics(net), errors), dataset, "", "metric_report", "csv")
    run.say("\n".join(R.table_text(R.ranked(measured, T.metrics(net)).join(errors, "graph_id"), T.metrics(net))), dataset=dataset, percent=100.0)


def snapshot_run(run: Run, dataset: str, net: NetworkFrame, sample: Gr.Sample, params: Gr.Params) -> None:
    """One network without a gate, and its states while it grew."""
    taken = P.grow_snapshots(run.spark, sample, params, run.config.every)
    if not run.config.disable_saving:
        sinks.write_snapshots(taken.select("snapshot_ix", "nodes", "edges"), f"{run.root}/{dataset}/snapshots")
    last = taken.orderBy(F.desc("snapshot_ix")).limit(1).withColumns({"trial": F.lit("run"), "candidate_id": F.lit(0).cast("long")})
    weigh = P.W.fit(net) if net.weighted else None
    done = P.finished(last, sample, weigh, params.seed)
    stamp = sinks.stamp()
    for extension in run.config.network_formats:
        run.save(done, dataset, SYNTHETIC, "synthetic_network", extension, "snapshot_run_n0_", stamp)
    run.say(f"{taken.count()} snapshots", dataset=dataset, percent=100.0)


def sweep(run: Run, dataset: str) -> None:
    c = run.config
    if c.count <= 0:
        raise ValueError("a sweep needs synthetic networks")
    net = run.original(dataset)
    params, _ = run.params(net)
    trials = P.cut(P.sweep_grid(run.spark, net, params, c.node_range, c.edge_range, c.step, c.count, c.error_checker, c.error_tolerance, c.max_attempts, c.full_q_band), "trials")
    run.save(R.sweep_report(trials), dataset, "", "sweep_report", "csv")
    run.say(f"{trials.count()} trials", dataset=dataset, percent=100.0)


def hybrid(run: Run, dataset: str) -> None:
    c = run.config
    net = run.original(dataset)
    node_factor, edge_factor = c.factors_of(dataset)
    params, frame = run.params(net, node_factor, edge_factor)
    sample = run.save_original(dataset, net)
    # Columns stretch the width, rows the height.
    scale = (float(c.scale[1]), float(c.scale[0]))
    if c.tile_frame:
        params, tile = replace(params, width=float(c.tile_frame[0]), height=float(c.tile_frame[1])), "fixed"
    else:
        tile = "factor"
    floor = c.spacing * max(frame) * c.tile_factor
    got, rounds = P.hybrid(run.spark, sample, params, scale, c.most_centres, c.spacing, c.max_rounds, c.least_tile_nodes, c.max_attempts, tile, c.tile_factor, floor, net, c.error_checker, c.error_tolerance, frame=frame, full_band=c.full_q_band)
    got = P.kept(got)
    stamp = sinks.stamp()
    for extension in c.network_formats:
        run.save(got, dataset, SYNTHETIC, "synthetic_network", extension, f"hybrid_{c.most_centres}centers_", stamp)
    run.save(report("Synthetic Network", got, T.attributes(got, Gr.MOST_VALUES)), dataset, SYNTHETIC, "report", "txt")
    run.say(f"stitched in {rounds} rounds", dataset=dataset, percent=100.0)


def compare(run: Run, dataset: str, inputs: dict) -> None:
    original, synthetic = (run.as_measured(tables.load(run.spark, inputs[k])) for k in COMPARED)
    reports = P.cut(P.compare(original, synthetic, run.config.full_q_band), "reports")
    for label in ("synthetic", "original"):
        run.save(reports.where(F.col("label") == label).orderBy("graph_id"), dataset, "", f"analysis_data_{label}", "json")
    run.save(P.spectra_table(reports), dataset, "", "spectra_analysis", "csv")


COMPARED = spec.COMPARED[0]


def run(spark: SparkSession, config, inputs: dict, source: Source | None = None, now: float | None = None, stop: threading.Event | None = None) -> str:
    """Runs a configuration over its data sets; returns the run's folder.

    The manifest is written whatever happens: ok, failed with the error, or cancelled.
    After ``stop`` is set, whatever ends the run counts as its cancelling.
    """
    datasets = config.datasets or tuple(sorted(tables.datasets(sinks.outputs(spark, inputs["datasets_dir"]))))
    if not datasets:
        raise ValueError(f"{inputs['datasets_dir']} holds no data sets")
    this = Run(spark, config, source or source_of(inputs), now, stop)
    work = {spec.GenerateConfig: generate, spec.HybridConfig: hybrid, spec.SweepConfig: sweep, spec.CompareConfig: lambda r, d: compare(r, d, inputs)}[type(config)]
    status, error = sinks.STATUS_OK, None
    try:
        for dataset in datasets:
            this.say("begun", dataset=dataset, percent=0.0)
            work(this, dataset)
    except KeyboardInterrupt:
        status = sinks.STATUS_CANCELLED
        raise
    except Exception as e:
        if this.stop.is_set():
            status = sinks.STATUS_CANCELLED
            raise Cancelled from e
        status, error = sinks.STATUS_FAILED, f"{type(e).__name__}: {e}"
        raise
    finally:
        if not config.disable_saving:
            for tag in spark.sparkContext.getJobTags():
                spark.sparkContext.removeJobTag(tag)  # the manifest's own jobs are not cancelled
            sinks.write_text(spark, f"{this.root}/run.jsonl", "".join(this.log))
            sinks.write_manifest(spark, this.root, status, error, this.metrics or None)
    return this.root


#: Seconds that a cancelled run has to end by itself before its jobs are ended.
GRACE = 15.0


class Background:
    """A run in a thread of its own: ``state``, ``wait`` and ``cancel``.

    All its jobs carry one tag.  Cancelling asks the run to end where it next
    reads, says or writes something; after ``grace`` seconds its jobs are ended, which
    ends the tasks and their Python workers.  The manifest is written either way.
    """

    def __init__(self, spark: SparkSession, config, inputs: dict, source: Source | None = None):
        self.spark, self.tag, self.stop = spark, f"run-{config.run_id}-{uuid.uuid4().hex[:8]}", threading.Event()
        self.root: str | None = None
        self.error: Exception | None = None
        self._ended = threading.Event()

        def work() -> None:
            spark.sparkContext.addJobTag(self.tag)
            try:
                self.root = run(spark, config, inputs, source, stop=self.stop)
            except Exception as e:
                self.error = e
            finally:
                spark.sparkContext.removeJobTag(self.tag)
                self._ended.set()

        self._thread = threading.Thread(target=inheritable_thread_target(spark)(work), daemon=True)
        self._thread.start()

    @property
    def state(self) -> str:
        """running, or as the manifest says: ok, failed or cancelled."""
        if not self._ended.is_set():
            return "running"
        return sinks.STATUS_OK if self.error is None else sinks.STATUS_CANCELLED if isinstance(self.error, Cancelled) else sinks.STATUS_FAILED

    def wait(self, seconds: float | None = None) -> str:
        self._ended.wait(seconds)
        return self.state

    def cancel(self, grace: float = GRACE) -> str:
        """Ends the run; what it says is how it ended."""
        self.stop.set()
        if not self._ended.wait(grace):
            # What writes the manifest has jobs of its own; they come after the run's work.
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
        return self.wait()


def run_spec(spark: SparkSession, text: str, source: Source | None = None, now: float | None = None) -> str:
    """As ``run``, from a JSON specification."""
    return run(spark, *spec.from_spec(text), source, now)
