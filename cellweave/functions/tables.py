"""What the operators share: input tables, written intermediate tables, numbering in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; where it is unset, a temporary one of a local session, never of a cluster."""
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cellweave-"))
    return context.getCheckpointDir()


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there, for tasks that read and write files of their own."""
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and it outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """``df`` with a gapless number in the given order, as a distributed sort.

    Rows are sorted by range and written; each partition's size (one row each) gives its offset. ``order`` must
    be total, or equal rows are numbered in any order.
    """
    marked = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begin = written(sizes.select("_part", (F.coalesce(before, F.lit(0)) + first).alias("_begin")), "begins")
    placed = marked.withColumn("_part", part).join(F.broadcast(begin), "_part")
    return placed.withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_begin")
