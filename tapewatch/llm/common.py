"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.storage import keep, ship_package, written

__all__ = ["keep", "ship_package", "written", "table", "by_bytes", "words_of", "let", "doc_fold", "join_small_keys"]

#: White space of the contracts: space and the ASCII controls tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, with only the columns asked for."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about limit bytes of the column's texts each, and a row at least."""
    for b in batches:
        sizes, start, held = pa.compute.binary_length(b.column(column)).to_pylist(), 0, 0
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= limit:
                yield b.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < len(sizes):
            yield b.slice(start)


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but SPACE_CLASS; null gives none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo folds."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def join_small_keys(rows: DataFrame, values: DataFrame, key: str, count: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of rows with values, which has each key once, with count rows of that key.

    Keys with more than total/parts rows number fewer than parts; these are broadcast, so that a
    hot key stays spread over its rows' partitions. All the others meet in an ordinary join.
    """
    limit = max(total // parts, 1)
    heavy = values.filter(F.col(count) > limit)
    light = values.filter(F.col(count) <= limit)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(rest)
