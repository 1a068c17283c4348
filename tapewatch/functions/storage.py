"""Cutting lineage with files that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()  # applications that have the package
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of all machines, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or not _PACKAGE.is_dir():
        return
    name = Path(tempfile.mkdtemp(prefix="package")) / f"{_PACKAGE.name}.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(name, "w") as z:
        for module in sorted(_PACKAGE.rglob("*.py")):
            z.write(module, module.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(name))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, as spark.checkpoint.dir names it; on one machine a temporary one is made if it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: unlike a checkpoint's, its readers take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is kept or written meanwhile leaves no shuffle files behind; otherwise they stay until the driver happens to collect its garbage."""
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def numbered(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """df with a gapless number in the given order, without sorting all rows in one task.

    Rows are range-sorted and written; each partition's first number is the sum of the counts of
    those before it, a table of one row a partition.
    """
    sorted_rows = keep(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = sorted_rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = sorted_rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(parts), "_part")
    number = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return rows.withColumn(name, number.cast("long")).drop("_part", "_at", "_base")


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each one in the given order; no task holds all rows.

    Rows are range-sorted and written; each partition adds to its own running sum the sums of those before it.
    """
    sorted_rows = keep(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = sorted_rows.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # one row a partition
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = sorted_rows.withColumn("_own", F.sum(value).over(within)).join(F.broadcast(parts), "_part")
    return rows.withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_at", "_base", "_own")
