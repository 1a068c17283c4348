"""Operator 11: sharding by rendezvous hashing of stable record keys. DataFrame only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.storage import numbered
from tapewatch.llm.common import keep, let

#: Hash digits of a draw; the seed is part of what is hashed.
DIGITS, SEED = 12, "shard"


def draw(key: Column, shard: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from the md5 of seed, key and shard."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), shard.cast("string"))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10)
    return (digits.cast("long") + 0.5) / float(16**DIGITS)


def waits(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """An array with (wait, shard) of each shard that has a weight: -ln(draw) / weight, in the shards' order."""
    shards = F.array(*(F.struct(F.lit(float(w)).alias("weight"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0))
    return F.transform(shards, lambda s: F.struct((-F.log(draw(key, s["shard"], seed)) / s["weight"]).alias("wait"), s["shard"].alias("shard")))


def assign(docs: DataFrame, key_col: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, grown_by: float = 1.0, seed: str = SEED) -> DataFrame:
    """A column row with the row of docs, then key, shard and grown_shard.

    Every shard draws a waiting time for the key, exponential with its weight as the rate, and the
    shortest wins (equal waits: the smaller shard), so shards get shares in proportion to their weights. Another
    shard's wait changes none of the others: with one more shard of weight grown_by, only the
    rows that it wins move (grown_shard). Nothing is shuffled. A null key counts as an empty text; shards
    of weight 0 get nothing.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in [*weights, grown_by]):
        raise ValueError("weights must not be negative, and one at least must be positive")
    key = F.col(f"`{key_col}`").cast("string")
    now = sum(w > 0 for w in weights)
    won = let(waits(key, [*weights, grown_by], seed), lambda w: F.struct(F.array_min(F.slice(w, 1, now))["shard"].alias("shard"), F.array_min(w)["shard"].alias("grown_shard")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # so that no column's name can clash
    return docs.select(row.alias("row"), F.coalesce(key, F.lit("")).alias("key"), won.alias("won")).select("row", "key", "won.*")


def place(docs: DataFrame, key_col: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, grown_by: float = 1.0, then: Sequence[str] = (), seed: str = SEED) -> DataFrame:
    """The columns of docs, then shard (int), slot (long) and grown_shard (int).

    slot numbers the rows of a shard from 0 without gaps, by key, then by the columns in then, then by
    their place in the table. The numbers come from one range sort over all shards together and a
    table of counts by partition; as the place breaks all ties, a key with any share of the rows,
    even of equal rows, is spread over tasks like all others. A new column whose name docs has already gets
    a trailing underscore. Texts are sorted as a part of their rows, so give only the columns that are needed;
    an empty table gives no row.
    """
    rows = keep(assign(docs, key_col, weights, grown_by, seed).withColumn("place", F.monotonically_increasing_id()))
    ordered = numbered(rows, ["shard", F.col(f"row.`{key_col}`"), *(F.col(f"row.`{c}`") for c in then), "place"], "n", start=0)
    first = ordered.groupBy("shard").agg(F.min("n").alias("first"))  # one row a shard
    out = ordered.join(F.broadcast(first), "shard")
    new = {"shard": F.col("shard").cast("int"), "slot": F.col("n") - F.col("first"), "grown_shard": F.col("grown_shard").cast("int")}
    return out.select("row.*", *(v.alias(free_name(k, docs.columns)) for k, v in new.items()))


def free_name(name: str, taken: Sequence[str]) -> str:
    while name in taken:
        name += "_"
    return name


def write_shards(placed: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Write placed rows as Parquet folders path/shard=..., each a sequence of files in slot order.

    Ranges of (shard, slot) are about equal shares of the rows whatever the weights, so a large
    shard is several files and a task writes one range.
    """
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)
