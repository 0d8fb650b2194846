"""One measurement run: cells of two masks, all families of measurements, and the checks before it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.groups import grouped
from cellweave.functions.tables import written

from . import compartments as cp, labels as lb, matching as mt, morphology as mo, neighbours as nb, outlines as ol, raster as ra, shape as sh

MODES = ("exact", "fast", "fast_small_cells")
#: Cells below this size have no percentiles in the mode for small cells.
SMALL_CELL = 25
#: Neighbours are looked for within this distance.
NEIGHBOUR_MICRONS = 20.0


def parse_percentiles(text: str) -> list[float]:
    """``"10, 50,,90"`` as numbers; blanks are skipped."""
    out = [float(p) for p in (x.strip() for x in text.split(",")) if p]
    if any(not 0 <= p <= 100 for p in out):
        raise ValueError(f"percentiles are between 0 and 100: {text!r}")
    return out


@dataclass(frozen=True)
class Options:
    """What a run is asked for; checked on creation."""

    dist_threshold: float = 10.0
    estimate_cell_boundary_dist: float = 3.0
    measurements: bool = True
    percentiles: list[float] = field(default_factory=list)
    erosion_steps: bool = True
    expansion_steps: bool = True
    environment_expansion: bool = False
    neighbours: int = 0
    pixel_size_microns: float = 0.5
    downsample_factor: float = 1.0
    performance_mode: str = "exact"

    def __post_init__(self) -> None:
        for name, good in (
            ("dist_threshold", self.dist_threshold > 0),
            ("estimate_cell_boundary_dist", self.estimate_cell_boundary_dist > 0),
            ("neighbours", self.neighbours >= 0),
            ("pixel_size_microns", self.pixel_size_microns > 0),
            ("downsample_factor", self.downsample_factor > 0),
        ):
            if not good:
                raise ValueError(f"{name} is out of range: {getattr(self, name)}")
        if self.performance_mode not in MODES:
            raise ValueError(f"performance_mode is one of {', '.join(MODES)}, not {self.performance_mode!r}")

    @property
    def pixel(self) -> float:
        """Microns a pixel after downsampling."""
        return self.pixel_size_microns * ra.step_of(self.downsample_factor)


def check_masks(nuclei: DataFrame | None, whole: DataFrame | None, sizes: dict[str, tuple[int, ...]]) -> tuple[int, int]:
    """The common size of the masks and images named in ``sizes`` (rows and columns last); errors if there is none."""
    if nuclei is None and whole is None:
        raise ValueError("at least one mask is needed")
    for name, size in sizes.items():
        if len(size) != (3 if name == "image" else 2):
            raise ValueError(f"{name} has {len(size)} axes: {size}")
    grids = {tuple(size[-2:]) for size in sizes.values()}
    if len(grids) != 1:
        raise ValueError("masks and image differ in size: " + ", ".join(f"{n} {tuple(s)}" for n, s in sizes.items()))
    return grids.pop()


def check_inside(pixels: DataFrame, size: tuple[int, int], name: str) -> None:
    """No pixel may lie outside the grid."""
    h, w = size
    if not pixels.filter(~(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))).isEmpty():
        raise ValueError(f"{name} has pixels outside {h} x {w}")


def contains(row: Column, column: Column, top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """Whether a point lies in a half-open box."""
    return (row >= top) & (row < bottom) & (column >= left) & (column < right)


def all_cells(nuclei: DataFrame | None, whole: DataFrame | None, size: tuple[int, int], options: Options = Options()) -> tuple[DataFrame, DataFrame | None]:
    """The cell records of a run, and the pixels ``r, c, label`` grown around nuclei without a cell (by nucleus label).

    With one mask every label is a cell. With two, matches by overlap come first, then those by distance, then cells
    grown around the nuclei that are left, by nucleus label; ids run on through all three, and a nucleus that finds
    no free place leaves its id unused.
    """
    if nuclei is None or whole is None:
        return lb.single_mask_cells(whole if nuclei is None else nuclei, "wc_only" if nuclei is None else "nuc_only"), None
    matched = written(mt.matched_cells(nuclei, whole, options.dist_threshold), "cells")
    seeds = written(nuclei.filter("label > 0").join(matched.select(F.col("nucleus_label").alias("label")), "label", "left_anti").select("r", "c", "label"), "seeds")
    claimed = whole.join(matched.select(F.col("whole_cell_label").alias("label")), "label", "left_semi")
    reach = options.estimate_cell_boundary_dist
    zone = written(ra.growth_zone(seeds, claimed, reach, size), "zone")
    first = (matched.agg(F.max("cell_id")).first()[0] or 0) + 1
    grown_cells, grown = ol.synthesised(seeds, zone, reach, first)
    return matched.drop("by_distance").unionByName(grown_cells), grown


#: What is measured at a place, a bit each, with its kind: 0 for compartments, 1 for rings, 2 for environments.
TAGS = [("Cell", 0), ("Nucleus", 0), ("Cytoplasm", 0), ("Membrane", 0)]
TAGS += [(f"{part}: ErosionBin_{b}", 1) for part in ("Cell", "Nucleus") for b in range(1, mo.BINS + 1)]
TAGS += [(f"Cell: ExpansionBin_{b}", 1) for b in range(1, mo.BINS + 1)] + [("Cell: Environment_20um", 2)]
_EROSION, _EXPANSION, _ENVIRONMENT = 4, 4 + 2 * mo.BINS, 4 + 3 * mo.BINS
#: The bit of cells that are large enough for percentiles.
_RANKED = len(TAGS)


def _tagged(pixels: DataFrame, cells: DataFrame, size: tuple[int, int], options: Options) -> DataFrame:
    """``cell_id, tags`` and places, packed: every place of a cell once, with the bits of all that is measured there."""
    reach = mo.reach_px(options.pixel)
    least = SMALL_CELL if options.performance_mode == "fast_small_cells" else 0

    def families(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        g, (r, c) = mo.numbers(table, starts), (table[x].to_numpy().astype(np.int64) for x in ("r", "c"))
        nucleus, membrane, bounded = (table[x].to_numpy() for x in ("is_nuc", "is_membrane", "_b"))
        some = np.maximum.reduceat(nucleus, starts)[g]
        big = np.bincount(g)[g] >= least if options.percentiles else np.zeros(len(g), bool)
        tags = 1 + (nucleus.astype(np.int64) << 1) + ((bounded & some & ~nucleus).astype(np.int64) << 2) + ((bounded & membrane).astype(np.int64) << 3) + (big.astype(np.int64) << _RANKED)
        if options.erosion_steps:
            tags |= 1 << (_EROSION - 1 + mo.shells(g, mo.inner_depths(g, r, c), True))
            if (k := np.flatnonzero(nucleus)).size:
                tags[k] |= 1 << (_EROSION + mo.BINS - 1 + mo.shells(g[k], mo.inner_depths(g[k], r[k], c[k]), True))
        parts = [(g, r, c, tags)]
        if options.expansion_steps or options.environment_expansion:
            og, orow, ocol, depth = mo.outer_places(g, r, c, reach, size)
            around = np.full(len(og), 1 << _ENVIRONMENT if options.environment_expansion else 0)
            if options.expansion_steps:
                around |= 1 << (_EXPANSION - 1 + mo.shells(og, depth, False))
            parts.append((og, orow, ocol, around))
        g, r, c, tags = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = table["cell_id"].to_numpy()[starts][g]
        return cp.pack(pa.table({"cell_id": ids, "r": r, "c": c, "tags": pa.array(tags, pa.int32())}), ["cell_id", "tags"], [])

    own = pixels.join(cp.bounded(cells), "cell_id").select(F.col("cell_id").cast("long").alias("cell_id"), "r", "c", "is_nuc", "is_membrane", "_b")
    return grouped(own, ["cell_id"], families, "cell_id long, tags int, by_ int, bx_ int, at array<smallint>")


def _intensities(tagged: DataFrame, image: DataFrame, channels: DataFrame, options: Options) -> DataFrame:
    """``cell_id, ch, key, value`` of all families: the image is read once and meets each place once, whatever lies there."""
    exact = options.performance_mode == "exact"
    bit = lambda i: F.col("tags").bitwiseAND(F.lit(1 << i)) != 0
    told = [F.when(bit(i), F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("kind"), (bit(_RANKED) if kind == 0 else F.lit(False)).alias("ranked"))) for i, (tag, kind) in enumerate(TAGS)]
    rows = cp.sampled(tagged, image, ["cell_id", "tags"]).repartition("cell_id")
    rows = rows.select("cell_id", "ch", "vals", F.inline(F.array_compact(F.array(*told))))
    at = [0.5, *[p / 100.0 for p in options.percentiles]]
    found = cp.statistics(cp.gathered(rows, ["cell_id", "tag", "kind", "ranked", "ch"]), at)
    ring = F.col("kind") == 1
    of = lambda key, value, when: F.when(when, F.struct(F.lit(key).alias("k"), value.cast("double").alias("value")))
    middle = F.get("q", F.lit(0))
    wanted = {"mean": F.lit(True), "median": F.lit(exact) | (F.col("kind") > 0)}  # the others but for rings
    pairs = [of(k, middle if c == "median" else F.col(c), wanted.get(c, ~ring)) for k, c in cp.STATISTICS.items()]
    pairs += [of(f"Percentile: {float(p)}", F.get("q", F.lit(i + 1)), F.col("ranked")) for i, p in enumerate(options.percentiles)]
    named = found.join(F.broadcast(channels), "ch").select("cell_id", "ch", "name", "tag", F.explode(F.array_compact(F.array(*pairs))).alias("_p"))
    return named.select("cell_id", "ch", F.concat_ws(": ", "name", "tag", F.col("_p.k")).alias("key"), F.col("_p.value").alias("value"))


def _shape(pixels: DataFrame, pixel: float) -> DataFrame:
    """``cell_id, key, value`` of the shape of cells and nuclei."""
    nucleus = cp.with_membrane(pixels.filter("is_nuc").drop("is_membrane"))
    parts = None
    for name, own in (("CELL", pixels), ("NUCLEUS", nucleus)):
        sums = sh.moments(own)
        rows = sums.select("cell_id", "area").join(sh.axes(sums), "cell_id").join(sh.perimeter(own.filter("is_membrane")), "cell_id", "left").join(sh.solidity(own), "cell_id")
        rows = rows.withColumn("perimeter", F.coalesce("perimeter", F.lit(0.0))).withColumn("compartment", F.lit(name))
        parts = rows if parts is None else parts.unionByName(rows)
    return sh.shape_measurements(written(parts, "shape"), pixel)


def measure(cells: DataFrame, nuclei: DataFrame, whole: DataFrame, image: DataFrame, channels: DataFrame, size: tuple[int, int], options: Options = Options(), grown: DataFrame | None = None) -> DataFrame:
    """``cell_id, key, value``: every measurement of every cell, under its published name.

    Masks and image (``ch, r, c, v`` on the whole grid; ``channels`` has ``ch, name``) are on the grid of the cells;
    ``options.pixel`` gives its pixels' size. What does not exist has no row: empty compartments, statistics of
    nothing, and medians outside the exact mode. Of channels that share a name the last counts. A cell without
    pixels has no rows; an empty table gives an empty one.
    """
    pixels = written(cp.cell_pixels(cells, nuclei, whole, grown), "pixels")
    rows = _intensities(_tagged(pixels, cells, size, options), image, channels, options)
    long = rows.groupBy("cell_id", "key").agg(F.max_by("value", "ch").alias("value")).unionByName(_shape(pixels, options.pixel))
    if not options.neighbours:
        return long
    long = written(long, "measurements")
    near = nb.nearest(cells, options.neighbours, NEIGHBOUR_MICRONS / options.pixel)
    return long.unionByName(nb.neighbour_means(near, long))


def on_grid(nuclei: DataFrame | None, whole: DataFrame | None, image: DataFrame | None, size: tuple[int, int], options: Options = Options()) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None, tuple[int, int]]:
    """Masks and image on the coarser grid that ``options`` asks for, and its size; pixels outside the grid are an error."""
    for name, pixels in (("nuclear mask", nuclei), ("whole-cell mask", whole)):
        if pixels is not None:
            check_inside(pixels, size, name)
    step = ra.step_of(options.downsample_factor)
    if step < 2 or min(size) < step:
        return nuclei, whole, image, size
    coarse = [p if p is None else written(ra.downsample_mask(p, size, options.downsample_factor), "mask") for p in (nuclei, whole)]
    image = None if image is None else written(ra.downsample_image(image, size, options.downsample_factor), "image")
    return *coarse, image, (size[0] // step, size[1] // step)


def run(nuclei: DataFrame | None, whole: DataFrame | None, image: DataFrame | None, channels: DataFrame | None, size: tuple[int, int], options: Options = Options()) -> tuple[DataFrame, DataFrame | None]:
    """Cells and their measurements (``cell_id, key, value``; none without an image or where switched off) from masks on one grid.

    The masks and the image are checked and brought to the coarser grid first, if one is asked for.
    """
    if nuclei is None and whole is None:
        raise ValueError("at least one mask is needed")
    nuclei, whole, image, size = on_grid(nuclei, whole, image, size, options)
    cells, grown = all_cells(nuclei, whole, size, options)
    cells = written(cells, "cells")
    if image is None or not options.measurements:
        return cells, None
    none = (nuclei if nuclei is not None else whole).limit(0)
    return cells, measure(cells, none if nuclei is None else nuclei, none if whole is None else whole, image, channels, size, options, grown)
