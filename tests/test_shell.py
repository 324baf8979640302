"""The commands of ``python -m filigree``."""

import json

from filigree import __main__ as shell
from filigree.sources import spec


def test_data_sets_are_listed(tmp_path, capsys):
    for name in ("b_edgelist.csv", "b_positions.csv", "deep/a.graphml", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert shell.main(["datasets", str(tmp_path)]) == 0
    assert capsys.readouterr().out.split() == ["b", "deep/a"]


def test_a_bad_specification_is_told(tmp_path, capsys):
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"contract": 1}))
    assert shell.main(["check", str(file)]) == 2 and "contract: must be 2" in capsys.readouterr().err
    assert shell.main(["run", str(tmp_path / "none.json")]) == 2


def test_a_comparison_is_a_specification():
    config, inputs = spec.from_spec(shell.comparison(shell._arguments(["compare", "a", "b", "out", "--full-band", "--weights", "no"])))
    assert isinstance(config, spec.CompareConfig) and config.full_q_band and config.measure_weighted is False
    assert inputs == {"original_networks": "a", "synthetic_networks": "b"} and config.output_dir == "out"


def test_a_run_prints_its_folder(tmp_path, capsys, monkeypatch, spark):
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"contract": 2, "mode": "generate", "run_name": "r", "output_dir": str(tmp_path), "inputs": {"network_graphml": "n"}, "params": {"CLOSED_NODES_FACTOR": 1, "CLOSED_EDGES_FACTOR": 1}}))
    monkeypatch.setattr(shell.runs, "run", lambda s, config, inputs: f"{config.output_dir}/done")
    assert shell.main(["check", str(file)]) == 0 and shell.main(["run", str(file)]) == 0
    assert capsys.readouterr().out.strip() == f"{tmp_path}/done"
