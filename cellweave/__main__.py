"""``python -m cellweave``: a whole job from the command line; every field of ``Job`` and ``Options`` is an option."""

from __future__ import annotations

import argparse
import sys
from dataclasses import MISSING, Field, fields

from pyspark.sql import SparkSession

from cellweave.operators import measure as me
from cellweave.plans.job import Job, run

#: What the options do, by field.
HELP = {
    "nuclear_mask": "nuclear label mask: a TIFF file or a store of chunked arrays",
    "whole_cell_mask": "whole-cell label mask, likewise",
    "parquet_path": "boundary table inside a store, to be burned instead of reading its labels",
    "tiff_file": "multi-channel image; needed for measurements",
    "output_file": "GeoJSON file to write",
    "output_mask": "TIFF file for the label mask of the final polygons",
    "pretty_json": "indented GeoJSON",
    "gzip": "compressed GeoJSON; .gz is added to the name where it lacks",
    "simplify_rois": "simplify outlines",
    "tolerance": "how far, in pixels, a simplified outline may lie from its corners",
    "constrain_overlaps": "trim overlapping cells",
    "geometry_checkpoint_dir": "folder in which traced outlines are kept, so that a broken run goes on where it stopped",
    "resume_geometry": "go on from outlines kept earlier",
    "geometry_batch_size": "labels in a batch of outlines",
    "dist_threshold": "how far, in pixels, the centre of a nucleus without overlap may lie from its cell's",
    "estimate_cell_boundary_dist": "how far, in pixels, a nucleus without a cell is grown",
    "measurements": "measure the image",
    "percentiles": "percentiles of intensities, by commas",
    "erosion_steps": "measure inward shells",
    "expansion_steps": "measure outward shells of 20 microns",
    "environment_expansion": "measure the surroundings of 20 microns as one",
    "neighbours": "neighbours whose mean measurements are told; 0 for none",
    "pixel_size_microns": "microns a pixel",
    "downsample_factor": "measure on a grid coarser by this factor",
    "performance_mode": "fast modes leave out medians",
}


def _option(parser: argparse.ArgumentParser, f: Field) -> None:
    default = f.default if f.default_factory is MISSING else f.default_factory()
    names = [f"--{f.name.replace('_', '-')}"] + (["--neighbors"] if f.name == "neighbours" else [])
    if isinstance(default, bool):
        parser.add_argument(*names, action=argparse.BooleanOptionalAction, default=default, help=HELP[f.name])
    elif f.name == "percentiles":
        parser.add_argument(*names, type=me.parse_percentiles, default=default, help=HELP[f.name])
    elif f.name == "performance_mode":
        parser.add_argument(*names, choices=me.MODES, default=default, help=HELP[f.name])
    else:
        parser.add_argument(*names, type=type(default) if isinstance(default, (int, float)) else str, default=default, help=HELP[f.name])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("cellweave", description="Matches nuclei and whole cells of segmentation masks, measures an image under them, and writes their outlines.")
    for f in (*fields(Job), *fields(me.Options)):
        if f.name != "options":
            _option(out, f)
    out.set_defaults(output_file="cells.geojson")
    return out


def job_of(arguments: list[str]) -> Job:
    """The job that a command line asks for; what can't be is an error before anything is read."""
    given = vars(parser().parse_args(arguments))
    options = me.Options(**{f.name: given.pop(f.name) for f in fields(me.Options)})
    if options.measurements and not given["tiff_file"]:
        raise ValueError("--tiff-file is needed for measurements; --no-measurements leaves them out")
    return Job(**given, options=options)


def main(arguments: list[str] | None = None) -> int:
    try:
        job = job_of(sys.argv[1:] if arguments is None else arguments)
        result = run(SparkSession.builder.appName("cellweave").getOrCreate(), job)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    print(f"{result.features.count()} cells of {result.size[0]} x {result.size[1]} pixels in {job.output_file}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
