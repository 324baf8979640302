"""Runs from a shell, on the session that spark-submit or the environment gives.

    python -m filigree run SPECIFICATION.json
    python -m filigree check SPECIFICATION.json
    python -m filigree compare ORIGINAL SYNTHETIC OUTPUT [--full-band] [--weights yes|no]
    python -m filigree datasets FOLDER
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import runs
from .sources import network_format, spec


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="filigree", description="Measure, grow, sweep and compare spatial networks.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("run", "run a specification; prints the run's folder"), ("check", "say what is wrong with a specification")):
        commands.add_parser(name, help=text).add_argument("specification", type=Path)
    compare = commands.add_parser("compare", help="reports of two sets of networks; prints the run's folder")
    for name in ("original", "synthetic", "output"):
        compare.add_argument(name)
    compare.add_argument("--full-band", action="store_true", help="spectra over the full band of q")
    compare.add_argument("--weights", choices=("yes", "no"), help="measure with weights or without; as stored if left out")
    commands.add_parser("datasets", help="names of a folder's data sets").add_argument("folder")
    return parser.parse_args(argv)


def comparison(a: argparse.Namespace) -> str:
    """The specification of a comparison."""
    params = {"FULL_Q_BAND": a.full_band} | ({"MEASURE_WEIGHTED": a.weights == "yes"} if a.weights else {})
    return json.dumps({"contract": spec.CONTRACT, "mode": "compare", "run_name": "compare", "output_dir": a.output, "inputs": {"original_networks": a.original, "synthetic_networks": a.synthetic}, "params": params})


def main(argv: Sequence[str] | None = None) -> int:
    a = _arguments(argv)
    if a.command == "datasets":
        print("\n".join(sorted(network_format.data_sets(a.folder))))
        return 0
    try:
        text = comparison(a) if a.command == "compare" else a.specification.read_text(encoding="utf-8")
        config, inputs = spec.from_spec(text)
    except (OSError, spec.SpecError) as e:
        print(f"filigree: {e}", file=sys.stderr)
        return 2
    if a.command != "check":
        print(runs.run(SparkSession.builder.appName("filigree").getOrCreate(), config, inputs))
    return 0


if __name__ == "__main__":
    sys.exit(main())
