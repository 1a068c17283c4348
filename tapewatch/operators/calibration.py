"""Market statistics of trades (symbol, date, time_us, price, size) and quotes (symbol, date, time_us, bid, ask, bidsiz, asksiz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.functions.storage import running_total

PERCENTS = (10, 25, 50, 75, 90, 99)


def nearest_rank(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, min, max and p10 to p99 of value by keys, by nearest rank: index round_half_even(p / 100 * (n - 1)).

    Values are counted first; their ranks come from a running total over the range-sorted counts, less the
    total before the group. So neither a group's rows nor its values are gathered in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_total(counts, [*keys, value], "_c", "_all")
    groups = ranked.groupBy(*keys).agg(F.min(F.col("_all") - F.col("_c")).alias("_start"), F.sum("_c").alias("_n"))
    ranked = ranked.join(groups, list(keys)) if keys else ranked.join(F.broadcast(groups))  # without keys one row
    end = F.col("_all") - F.col("_start")
    index = lambda p: F.bround(F.lit(p / 100) * (F.col("_n") - 1)).cast("long")
    at = lambda p: F.max(F.when((end > index(p)) & (end - F.col("_c") <= index(p)), F.col(value)))
    total = F.sum(F.col(value) * F.col("_c")) / F.sum("_c")
    return ranked.groupBy(*keys).agg(F.sum("_c").alias("n"), total.alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *(at(p).alias(f"p{p}") for p in PERCENTS))


def with_overall(df: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """nearest_rank for each key and, with a null key, for all rows."""
    overall = nearest_rank(df, value).withColumn(key, F.lit(None).cast("string"))
    return nearest_rank(df, value, (key,)).unionByName(overall)


def clean_trades(trades: DataFrame) -> DataFrame:
    return trades.filter("size > 0")


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with sizes on both sides; a size column that is missing counts as 1."""
    for c in ("bidsiz", "asksiz"):
        if c not in quotes.columns:
            quotes = quotes.withColumn(c, F.lit(1.0))
    return quotes.filter("bidsiz > 0 and asksiz > 0")


def spreads(quotes: DataFrame, tick: float = 0.01) -> DataFrame:
    """Spread in ticks and basis points of the quotes that aren't crossed or locked."""
    spread, mid = F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2
    return quotes.filter(spread > 0).withColumns({"spread_ticks": spread / tick, "spread_bps": spread / mid * 1e4, "implausible": spread / mid * 1e4 > 200})


def price_moves(trades: DataFrame, tick: float = 0.01, largest: float = 0.1) -> DataFrame:
    """Moves between a symbol's consecutive trades of a day; dropped marks jumps beyond largest."""
    w = Window.partitionBy("symbol", "date").orderBy("time_us", "trade_no")
    moves = trades.withColumn("before", F.lag("price").over(w)).filter("before is not null")
    jump = F.abs(F.col("price") - F.col("before")) / F.col("before")
    return moves.withColumns({"ticks": F.abs(F.col("price") - F.col("before")) / tick, "jump": jump, "dropped": jump > largest})


def top_jumps(moves: DataFrame, n: int = 20) -> DataFrame:
    return moves.orderBy(F.desc("jump"), "symbol", "date", "time_us", "trade_no").limit(n)


def quote_trade_ratios(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes for each trade, by symbol and date of the trades."""
    t = trades.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n_trades"))
    q = quotes.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n_quotes"))
    both = t.join(q, ["symbol", "date"], "left").withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0).cast("long")))
    return both.withColumn("ratio", F.col("n_quotes") / F.col("n_trades"))


def arrival_rate(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """window_seconds (average span of a symbol's day) and events a second for each symbol."""
    both = trades.select("symbol", "date", "time_us", F.lit(True).alias("is_trade")).unionByName(quotes.select("symbol", "date", "time_us", F.lit(False).alias("is_trade")))
    days = both.groupBy("symbol", "date").agg(((F.max("time_us") - F.min("time_us")) / 1e6).alias("span"), F.count(F.lit(1)).alias("n"), F.bool_or("is_trade").alias("traded"))
    out = days.agg(F.avg("span").alias("window_seconds"), F.sum("n").alias("n_events"), F.count_if("traded").alias("symbol_days"))
    return out.withColumn("rate", F.try_divide(F.try_divide(F.col("n_events"), F.col("symbol_days")), F.col("window_seconds")))


def code_crosstab(trades: DataFrame, code: str, top: int = 10) -> DataFrame:
    """The top codes with their numbers of trades without and with a size, and the share without."""
    zero = F.col("size") <= 0
    counts = trades.groupBy(code).agg(F.count_if(zero).alias("n_zero"), F.count_if(~zero).alias("n_sized"))
    return counts.withColumn("zero_share", F.col("n_zero") / (F.col("n_zero") + F.col("n_sized"))).orderBy(F.desc(F.col("n_zero") + F.col("n_sized")), code).limit(top)


def zero_size_matches(trades: DataFrame) -> DataFrame:
    """Trades without a size by whether one with a size shares their time and price, their price that day, or neither."""
    cents = F.round("price", 4)
    sized, bare = trades.filter("size > 0"), trades.filter("size <= 0").withColumn("_p", cents)
    exact = sized.select("symbol", "date", "time_us", cents.alias("_p")).distinct().withColumn("_exact", F.lit(True))
    same = sized.select("symbol", "date", cents.alias("_p")).distinct().withColumn("_same", F.lit(True))
    rows = bare.join(exact, ["symbol", "date", "time_us", "_p"], "left").join(same, ["symbol", "date", "_p"], "left")
    kind: Column = F.when(F.col("_exact"), "exact").when(F.col("_same"), "same_price").otherwise("isolated")
    return rows.groupBy(kind.alias("match")).agg(F.count(F.lit(1)).alias("n"))
