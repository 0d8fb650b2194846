"""A whole job: masks and image by path, cells, measurements, outlines, and the files asked for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.functions.tables import written
from cellweave.operators import compartments as cp, measure as me, outlines as ol, overlay as ov, raster as ra
from cellweave.sources import boundaries as bd, export, tiff
from cellweave.sources.masks import load_boundaries, load_mask

from . import outline_store


@dataclass(frozen=True)
class Job:
    """What goes in, what comes out, and how; checked on creation."""

    nuclear_mask: str | None = None
    whole_cell_mask: str | None = None
    parquet_path: str | None = None
    tiff_file: str | None = None
    output_file: str | None = None
    output_mask: str | None = None
    pretty_json: bool = False
    gzip: bool = False
    simplify_rois: bool = True
    tolerance: float = 0.5
    constrain_overlaps: bool = True
    geometry_checkpoint_dir: str | None = None
    resume_geometry: bool = True
    geometry_batch_size: int = 2000
    options: me.Options = field(default_factory=me.Options)

    def __post_init__(self) -> None:
        if self.nuclear_mask is None and self.whole_cell_mask is None:
            raise ValueError("at least one mask is needed")
        if self.tolerance < 0:
            raise ValueError(f"tolerance is out of range: {self.tolerance}")
        if self.geometry_batch_size < 1:
            raise ValueError(f"geometry_batch_size is out of range: {self.geometry_batch_size}")


@dataclass(frozen=True)
class Result:
    """``cells``; ``measurements`` (``cell_id, key, value``, if asked for); ``shapes`` (``overlay.SHAPES``, by cell); ``features``."""

    cells: DataFrame
    measurements: DataFrame | None
    shapes: DataFrame
    features: DataFrame
    size: tuple[int, int]


def run(spark: SparkSession, job: Job) -> Result:
    """Runs the job, writes the files that it names, and gives the tables behind them."""
    given = {"nuclear mask": job.nuclear_mask, "whole-cell mask": job.whole_cell_mask}
    found = {name: load_mask(spark, path, job.parquet_path) for name, path in given.items() if path}
    sizes: dict[str, tuple[int, ...]] = {name: size for name, (_, size) in found.items()}
    image = channels = None
    if job.tiff_file and job.options.measurements:
        tiff.register(spark)
        image, channels = spark.read.format("cyximage").load(job.tiff_file), tiff.channel_table(spark, job.tiff_file)
        sizes["image"] = tiff.inspect(job.tiff_file)["shape"]
    nuclei, whole = (written(found[name][0], "mask") if name in found else None for name in given)
    size = me.check_masks(nuclei, whole, sizes)
    nuclei, whole, image, size = me.on_grid(nuclei, whole, image, size, job.options)
    cells, grown = me.all_cells(nuclei, whole, size, job.options)
    cells = written(cells, "all-cells")
    none = (nuclei if nuclei is not None else whole).limit(0)
    nuclei, whole = (none if p is None else p for p in (nuclei, whole))
    long = maps = None
    if image is not None:
        long = written(me.measure(cells, nuclei, whole, image, channels, size, job.options, grown), "all-measurements")
        maps = cp.as_map(long)
    tolerance = job.tolerance if job.simplify_rois else 0.0
    shapes = _cell_shapes(spark, job, cells, cp.cell_pixels(cells, nuclei, whole, grown), tolerance)
    kernels = _by_cell(cells, "nucleus_label", ol.outlines(nuclei, tolerance))
    kernels = written(ov.shapes_of(kernels), "kernels")
    if job.constrain_overlaps:
        shapes = ov.trimmed(shapes)
    shapes = written(shapes, "final-shapes")
    if job.constrain_overlaps:
        kernels = ov.clipped(kernels, shapes)
    by_cell = lambda rows: ov.rings_of(rows).withColumnRenamed("label", "cell_id")
    features = written(export.features(cells, by_cell(shapes), by_cell(kernels), maps), "features")
    if job.output_file:
        export.write_geojson(features, size, job.output_file, job.pretty_json, job.gzip)
    if job.output_mask:
        tiff.write_mask(bd.painted(bd.rings(shapes.select("label", "geometry")), size), size, job.output_mask)
    return Result(cells, long, shapes, features, size)


def _by_cell(cells: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Rows of labels under the ids of the cells that have them."""
    ids = cells.filter(F.col(key).isNotNull()).select("cell_id", F.col(key).alias("label"))
    return rows.join(ids, "label").drop("label").withColumnRenamed("cell_id", "label")


def _cell_shapes(spark: SparkSession, job: Job, cells: DataFrame, pixels: DataFrame, tolerance: float) -> DataFrame:
    """The polygons of all cells before any is trimmed: a whole-cell mask's own boundary polygons where it has them, outlines of pixels else."""
    given = load_boundaries(spark, job.whole_cell_mask, job.parquet_path) if job.whole_cell_mask and ra.step_of(job.options.downsample_factor) < 2 else None
    own = None
    if given is not None:
        own = ov.boundary_shapes(_by_cell(cells, "whole_cell_label", given), tolerance)
        pixels = pixels.join(cells.filter("whole_cell_label is null").select("cell_id"), "cell_id", "left_semi")
    pixels = written(pixels.select(F.col("cell_id").alias("label"), "r", "c"), "shapes")
    if job.geometry_checkpoint_dir:
        outlines = outline_store.outlines(pixels, job.geometry_checkpoint_dir, tolerance, job.geometry_batch_size, job.resume_geometry)
    else:
        outlines = ol.outlines(pixels, tolerance)
    traced = ov.shapes_of(outlines)
    return traced if own is None else traced.unionByName(own)
