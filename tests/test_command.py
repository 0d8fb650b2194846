"""The command line: options become a job, wrong ones are told, and a run writes its files."""

from __future__ import annotations

import json

import numpy as np
import pytest

from cellweave import __main__ as command
from cellweave.operators import measure as me
from cellweave.plans.job import Job
from cellweave.sources import tiff


def test_options_become_a_job():
    made = command.job_of(["--whole-cell-mask", "w.tif", "--tiff-file", "i.tif", "--percentiles", "10, 90", "--no-erosion-steps", "--neighbors", "3", "--tolerance", "1.5", "--gzip", "--no-constrain-overlaps", "--geometry-batch-size", "7", "--performance-mode", "fast"])
    options = me.Options(percentiles=[10.0, 90.0], erosion_steps=False, neighbours=3, performance_mode="fast")
    assert made == Job(whole_cell_mask="w.tif", tiff_file="i.tif", output_file="cells.geojson", gzip=True, constrain_overlaps=False, tolerance=1.5, geometry_batch_size=7, options=options)
    assert set(command.HELP) == {f.name for f in (*command.fields(Job), *command.fields(me.Options))} - {"options"}


@pytest.mark.parametrize(("wrong", "message"), [([], "tiff-file"), (["--no-measurements"], "mask"), (["--nuclear-mask", "a.tif", "--no-measurements", "--dist-threshold", "0"], "dist_threshold"), (["--nuclear-mask", "a.tif", "--no-measurements", "--tolerance", "-1"], "tolerance")])
def test_wrong_options_are_told(capsys, wrong, message):
    assert command.main(wrong) == 1 and message in capsys.readouterr().err


@pytest.mark.parametrize("wrong", [["--percentiles", "10,101"], ["--performance-mode", "quick"], ["--neighbours", "x"], ["--nothing"]])
def test_what_no_option_takes_ends_the_program(wrong):
    with pytest.raises(SystemExit):
        command.job_of(wrong)


def test_a_run_writes_its_files(spark, tmp_path, capsys):
    mask = np.zeros((30, 30), np.uint16)
    mask[3:13, 4:14], mask[18:26, 18:26] = 1, 2
    tiff.save_tiff(tmp_path / "w.tif", [mask])
    tiff.save_tiff(tmp_path / "i.tif", [np.arange(900, dtype=np.uint16).reshape(30, 30)])
    arguments = ["--whole-cell-mask", str(tmp_path / "w.tif"), "--tiff-file", str(tmp_path / "i.tif"), "--output-file", str(tmp_path / "o.geojson"), "--no-expansion-steps", "--no-erosion-steps", "--performance-mode", "fast"]
    assert command.main(arguments) == 0 and "2 cells of 30 x 30 pixels" in capsys.readouterr().out
    found = json.loads((tmp_path / "o.geojson").read_text())["features"]
    assert [f["id"] for f in found] == ["annotation-whole-image", "cell-1", "cell-2"]
    measured = found[1]["properties"]["measurements"]
    assert measured["Channel 1: Cell: Mean"] == float(np.arange(900).reshape(30, 30)[3:13, 4:14].mean()) and "Channel 1: Cell: Median" not in measured
