"""Connected components by contraction: every vertex joins the neighbour that a fresh random order puts first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``vertex, root`` for each vertex of ``edges`` (``a, b``: long); the root is any one vertex of the component.

    Each round at least thins the graph by a constant factor (in expectation, whatever its shape, as the order is
    drawn anew), so the number of rounds grows with the logarithm of the largest component. Loops and repeated
    edges do no harm; an empty table gives an empty one.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    step = 0
    while not edges.isEmpty():
        order = lambda c: F.xxhash64(F.col(c), F.lit(step))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        first = both.groupBy("v").agg(F.min(F.struct(order("w").alias("o"), F.col("w"))).alias("n"))
        own = F.struct(order("v").alias("o"), F.col("v").alias("w"))
        first = written(first.select("v", F.least("n", own)["w"].alias("root")), "hooks")
        a, b = first.select(F.col("v").alias("a"), F.col("root").alias("ra")), first.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").filter("ra <> rb")
        edges = written(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if roots is None:
            roots = first.select(F.col("v").alias("vertex"), "root")
        else:
            step_roots = first.select(F.col("v").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(step_roots, "root", "left").select("vertex", F.coalesce("next", "root").alias("root")), "roots")
        step += 1
    return roots if roots is not None else edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
