"""Small expressions that detectors, generators and reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def lerp(low: float, high: float, t: Column) -> Column:
    return F.lit(low) + t * (high - low)


def round_to_tick(price: Column, tick: Column) -> Column:
    """The nearest multiple of tick, halves away from zero; price itself if tick is not positive."""
    return F.when(tick <= 0, price).otherwise(F.round(price / tick) * tick)


def whole_quantity(text: Column) -> Column:
    """A quantity's text as the nearest whole number, halves away from zero."""
    return F.round(text.try_cast("double")).cast("long")


def logistic(decision: Column) -> Column:
    """An isolation forest's decision value as a score between 0 and 1."""
    return clamp01(1 / (1 + F.exp(4 * decision)))


def exponential_gap(u: Column, rate: Column) -> Column:
    """The waiting time of a Poisson stream at quantile u."""
    return -F.log(1 - u) / rate


def config_version(prefix: str, config: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(config.cast("binary"), 256), 1, 12))


def fixed6(x: Column) -> Column:
    """Six decimals of a number below 1e9, rounded by its exact binary value (halves to even).

    Java rounds its shortest decimal form up at 5, which differs where that ends in a 5 that the number isn't quite: where it is the
    double nearest to an odd number of half millionths. On which side of that it lies shows the exact product with 2e6,
    taken by cutting the number in halves of 26 bits.
    """
    size, b = F.abs(x), F.lit(2e6)
    n, big = F.rint(size * b), size * 134_217_729.0
    high = big - (big - size)
    error = (high * b - n) + (size - high) * b
    below = (n < 2.0**50) & (n % 2 == 1) & (n / b == size) & ((error < 0) | ((error == 0) & (n % 4 == 1)))
    return F.format_string("%.6f", F.when(below, F.signum(x) * (n - 1) / b).otherwise(x))


def numbered_id(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "-%06d", number)


def share_of_largest(value: str, *keys: str) -> Column:
    """A value as a share of its group's largest."""
    return F.col(value) / F.max(value).over(Window.partitionBy(*keys))


def first_over_last(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: value at the smallest order divided by that at the largest; null if either is missing or 0."""
    ends = df.agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return ends.withColumn("factor", F.try_divide("first", "last"))
