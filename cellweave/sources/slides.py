"""Many slides in one relation: each gets a band of rows and a range of labels of its own, so that every operator takes them at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.operators.measure import NEIGHBOUR_MICRONS, Options
from cellweave.operators.morphology import reach_px

#: Free rows between two slides; no radius or reach of an operator may be larger.
GAP = 256
#: Rows are numbered by 32 bits; rings beyond a slide have to fit too.
MOST_ROWS = (1 << 31) - (1 << 20)


@dataclass(frozen=True)
class Slide:
    """Its name, rows and columns, and the largest label of its masks."""

    image_id: str
    size: tuple[int, int]
    labels: int


@dataclass(frozen=True)
class Stack:
    """Where each slide begins; a bounded table, one row for each slide."""

    slides: tuple[Slide, ...]
    gap: int = GAP

    def __post_init__(self) -> None:
        names = [s.image_id for s in self.slides]
        if len(set(names)) != len(names):
            raise ValueError("slides need names of their own")
        if self.size[0] > MOST_ROWS:
            raise ValueError(f"{len(names)} slides fill {self.size[0]} rows, of {MOST_ROWS} that there are: take fewer at once")

    def check(self, options: Options) -> None:
        """Nothing that ``options`` ask for may reach from one slide into the next."""
        pixel = options.pixel
        reach = {"dist_threshold": options.dist_threshold, "estimate_cell_boundary_dist": options.estimate_cell_boundary_dist, "expansion": reach_px(pixel), "neighbours": NEIGHBOUR_MICRONS / pixel if options.neighbours else 0.0}
        for name, far in reach.items():
            if far >= self.gap:
                raise ValueError(f"{name} reaches {far:g} rows, and slides lie {self.gap} apart")

    @property
    def size(self) -> tuple[int, int]:
        return sum(s.size[0] + self.gap for s in self.slides), max((s.size[1] for s in self.slides), default=0)

    def places(self, spark) -> DataFrame:
        """``image_id, first_row, last_row, first_label, last_label`` (exclusive ends)."""
        rows, r, n = [], 0, 0
        for s in self.slides:
            rows.append((s.image_id, r, r + s.size[0], n, n + s.labels))
            r, n = r + s.size[0] + self.gap, n + s.labels
        return spark.createDataFrame(rows, "image_id string, first_row long, last_row long, first_label long, last_label long")

    def stacked(self, rows: DataFrame, labels: Sequence[str] = ("label",)) -> DataFrame:
        """``rows`` (``image_id, r, ..``) with rows and labels moved to their slide's place; slides that aren't in the stack are left out."""
        at = F.broadcast(self.places(rows.sparkSession))
        moved = {"r": (F.col("r") + F.col("first_row")).cast("int")} | {c: F.when(F.col(c) > 0, F.col(c) + F.col("first_label")).otherwise(F.col(c)) for c in labels if c in rows.columns}
        return rows.join(at, "image_id").withColumns(moved).select([c for c in rows.columns if c != "image_id"])

    def slide_of(self, rows: DataFrame, row: Column, labels: Sequence[str] = (), rows_too: Sequence[str] = ()) -> DataFrame:
        """``rows`` with ``image_id``, told by the place ``row``; ``labels`` and ``rows_too`` are columns to bring back to their slide's own numbers."""
        at = F.broadcast(self.places(rows.sparkSession))
        joined = rows.join(at, (row >= F.col("first_row") - 0.5) & (row < F.col("last_row") + 0.5))
        back = {c: F.col(c) - F.col("first_label") for c in labels} | {c: F.col(c) - F.col("first_row") for c in rows_too}
        return joined.withColumns(back).select("image_id", *rows.columns)
