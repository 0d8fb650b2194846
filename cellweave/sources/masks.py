"""Label masks by path, whatever they are stored as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import boundaries, tiff, zarr


def load_mask(spark: SparkSession, path: str, boundary_table: str | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """``r, c, label`` and the mask's rows and columns.

    A ``.tif`` or ``.tiff`` file is read as it is. Of a store of chunked arrays the array is read, or, with
    ``boundary_table`` (a Parquet table's place in the store), its polygons are burned on the grid of its first image.
    """
    if path.lower().endswith((".tif", ".tiff")):
        tiff.register(spark)
        return spark.read.format("labelmask").load(path), tiff.inspect(path)["shape"][1:]
    if "." in path.rstrip("/").rpartition("/")[2] and not path.rstrip("/").endswith(".zarr"):
        raise ValueError(f"{path} is no mask: a .tif or .tiff file, or a directory of chunked arrays")
    found = load_boundaries(spark, path, boundary_table)
    if found is None:
        return zarr.read_mask(spark, path)
    size = zarr.image_size(spark, path)
    return boundaries.burned(boundaries.rings(found), size), size


def load_boundaries(spark: SparkSession, path: str, boundary_table: str | None) -> DataFrame | None:
    """``label, geometry`` of the boundary table that ``load_mask`` burns; None where it reads pixels."""
    if boundary_table is None or path.lower().endswith((".tif", ".tiff")):
        return None
    return boundaries.read_boundaries(spark, f"{path.rstrip('/')}/{boundary_table}")
