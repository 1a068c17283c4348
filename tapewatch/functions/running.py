"""Running values of keys of any size: totals by block of positions first, then within blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.storage import keep, numbered

#: A block has 2 ** BLOCK_BITS positions, and so many rows of a key at most.
BLOCK_BITS = 12
#: A table of up to so many keys is broadcast: some MB.
SENT_KEYS = 50_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, where null equals null; right has the keys and columns that left has not."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(renamed, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))).drop(*(f"_k_{k}" for k in keys))


def few_sent(table: DataFrame) -> DataFrame:
    """table, written once and broadcast to its join if it has few keys: a join by key would bring all rows of a hot key into one task."""
    kept = keep(table)
    return F.broadcast(kept) if kept.count() <= SENT_KEYS else kept


def with_position(rows: DataFrame, keys: list[str], order: list, name: str, number: str | None = None) -> DataFrame:
    """rows, written once, with their gapless number from 1 within their keys, in the given order; and with that over all rows as number, if named."""
    ranked = numbered(rows, [*keys, *order], "_n")
    first = few_sent(ranked.groupBy(*keys).agg(F.min("_n").alias("_first")))
    placed = join_keys(ranked, first, keys).withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_first")
    return placed.withColumnRenamed("_n", number) if number else placed.drop("_n")


def running_sums(rows: DataFrame, keys: list[str], at: str, sums: dict[str, str], bits: int = BLOCK_BITS) -> DataFrame:
    """rows (read twice) with the running sum of each column in sums (new name: column) of their key, by the position at.

    Rows of one key and block meet in one task, so a block's positions bound a task's part of a hot key; of
    each key and block one row of totals goes on. Positions must differ within a key.
    """
    rows = rows.withColumn("_block", F.shiftright(at, bits))
    by = [*keys, "_block"]
    inside = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by).agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    totals = totals.select(*by, *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    met = join_keys(own, totals, by)
    return met.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_block", *(f"_{name}" for name in sums))


def sums_within(rows: DataFrame, keys: list[str], at: str, span: int, sums: dict[str, str], bits: int = BLOCK_BITS) -> DataFrame:
    """keys, at and the sum of each column in sums (new name: column) over the rows of the key with at - span to at, both included.

    One row for each key and value of at: the difference of two running sums, at it and at a mark that stands span earlier, before
    what is exactly span old. So a window's rows are never gone through for each row, nor held by one task.
    """
    times = rows.groupBy(*keys, at).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    ends = F.array(F.struct(F.col(at).alias("_line"), F.lit(1).alias("_sign")), F.struct((F.col(at) - span).alias("_line"), F.lit(-1).alias("_sign")))
    line = times.select(*keys, at, F.explode(ends).alias("_e"), *sums).select(*keys, at, "_e.*", *(F.when(F.col("_e._sign") > 0, F.col(name)).otherwise(0).alias(name) for name in sums))
    line = running_sums(keep(with_position(line, keys, ["_line", "_sign"], "_place")), keys, "_place", {f"_all_{name}": name for name in sums}, bits)
    return line.groupBy(*keys, at).agg(*(F.sum(F.col("_sign") * F.col(f"_all_{name}")).alias(name) for name in sums))


def last_before(rows: DataFrame, keys: list[str], at: str, columns: dict[str, str], bits: int = BLOCK_BITS) -> DataFrame:
    """rows (read twice) with the last value that isn't null of each column in columns (new name: column) before the row, by the position at.

    As in running_sums, a block's rows meet in one task, and of each block its last values go on.
    """
    rows = rows.withColumn("_block", F.shiftright(at, bits))
    by = [*keys, "_block"]
    inside = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({name: F.last(c, ignorenulls=True).over(inside) for name, c in columns.items()})
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_{name}") for name, c in columns.items()))
    ends = ends.select(*by, *(F.last(f"_{name}", ignorenulls=True).over(before).alias(f"_{name}") for name in columns))
    met = join_keys(own, ends, by)
    return met.withColumns({name: F.coalesce(name, f"_{name}") for name in columns}).drop("_block", *(f"_{name}" for name in columns))


def best_covers(points: DataFrame, spans: DataFrame, top: int, bits: int = 6) -> DataFrame:
    """points (key, at and any more) with bid and ask: the largest worth of the spans of their side that cover them.

    spans: key, side, lo, hi (exclusive), worth. Spans are cut at blocks of 2 ** bits positions: pieces within a block are held against
    its points there, and what covers whole blocks is a span over block numbers, found in the same way one level up
    until one block holds all positions up to top. A block's pieces with equal ends are one piece, so
    that they number less than the square of its positions, whatever the number of spans. No task
    takes more than single blocks of any key.
    """
    size, cut = 1 << bits, lambda c, up=0: F.shiftright(F.col(c) + up * ((1 << bits) - 1), bits)
    low, high = F.col("_b0") * size, F.col("_b1") * size
    ends = spans.withColumns({"_b0": cut("lo", 1), "_b1": cut("hi")})
    one = F.array(F.struct("lo", "hi"))
    two = F.array(F.struct(F.col("lo"), low.alias("hi")), F.struct(high.alias("lo"), F.col("hi")))
    pieces = ends.select("key", "side", "worth", F.explode(F.when(F.col("_b0") > F.col("_b1"), one).otherwise(two)).alias("p")).select("key", "side", "worth", "p.lo", "p.hi").filter("lo < hi")
    pieces = pieces.groupBy("key", "side", cut("lo").alias("_block"), "lo", "hi").agg(F.max("worth").alias("worth"))
    pieces = pieces.groupBy("key", "_block").agg(F.collect_list(F.struct("side", "lo", "hi", "worth")).alias("_pieces"))
    points = points.withColumn("_block", cut("at"))
    out = points.join(pieces, ["key", "_block"], "left")
    covering = lambda side: F.array_max(F.transform(F.filter("_pieces", lambda p: (p["side"] == side) & (p["lo"] <= F.col("at")) & (F.col("at") < p["hi"])), lambda p: p["worth"]))
    out = out.withColumns({"bid": covering("Buy"), "ask": covering("Sell")}).drop("_pieces")
    if top < size:
        return out.drop("_block")
    whole = ends.filter("_b0 < _b1").select("key", "side", F.col("_b0").alias("lo"), F.col("_b1").alias("hi"), "worth")
    above = best_covers(points.select("key", F.col("_block").alias("at")).distinct(), whole, top >> bits, bits)
    above = above.select("key", F.col("at").alias("_block"), F.col("bid").alias("_bid"), F.col("ask").alias("_ask"))
    return out.join(above, ["key", "_block"], "left").withColumns({"bid": F.greatest("bid", "_bid"), "ask": F.greatest("ask", "_ask")}).drop("_block", "_bid", "_ask")
