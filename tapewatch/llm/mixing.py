"""Operator 4: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import keep

#: Hash digits that seed a draw, and the exponent that flattens the sources' natural shares.
DIGITS, FLATTEN = 12, 0.5


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts' text."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10)
    return digits.cast("long") / float(16**DIGITS)


def poisson_counts(rates: DataFrame) -> DataFrame:
    """rates with _from and _cdf: P(X <= k) for k from _from on, as far as hashed uniforms tell them apart.

    The mass at k is exp(k ln rate - rate - ln k!), which no rate underflows near its mode. Each
    row's range is its own: 9 standard deviations and 25 to both sides of its rate, so a large
    rate doesn't lengthen the arrays of the others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, cdfs = [], []
            for rate in b.column(1).to_pylist():
                reach = 9 * rate**0.5 + 25
                k = np.arange(max(0, int(rate - reach)), int(rate + reach) + 1)
                starts.append(int(k[0]))
                if rate <= 0:
                    cdfs.append([1.0])
                    continue
                logs = np.log(np.maximum(np.arange(k[0] + 1, k[-1] + 1), 1)).cumsum() + math.lgamma(k[0] + 1)
                cdfs.append(np.exp(k * math.log(rate) - rate - np.concatenate([[math.lgamma(k[0] + 1)], logs])).cumsum().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.int64()), pa.array(cdfs, pa.list_(pa.float64()))], names=["_source", "_rate", "_from", "_cdf"])

    return rates.select("_source", F.col("rate").alias("_rate")).mapInArrow(run, "_source string, _rate double, _from bigint, _cdf array<double>")


def source_rates(docs: DataFrame, source_col: str = "source", targets: dict[str, float] | None = None, flatten: float = FLATTEN, total: float = 1.0) -> DataFrame:
    """source, n_docs and rate: how often a document of each source is repeated on average.

    targets gives each source's share of the mixture; without it a source's share is its number
    of documents to the power flatten, so that small sources gain. The mixture has total times
    as many documents as docs on average. A source that targets doesn't name has rate 0.
    """
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    counts = docs.groupBy(source.alias("_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if targets is None:
        weighed = counts.withColumn("_weight", F.pow(F.col("n_docs").cast("double"), F.lit(flatten)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(w)) for k, w in targets.items()], "_source string, _weight double")
        weighed = counts.join(given, "_source", "left").fillna(0.0, ["_weight"])
    weighed = keep(weighed)
    whole = weighed.agg(F.sum("n_docs").alias("_docs"), F.sum("_weight").alias("_all"))  # one row
    rate = F.coalesce(F.try_divide(F.lit(total) * F.col("_docs") * F.col("_weight"), F.col("_all") * F.col("n_docs")), F.lit(0.0))
    return weighed.join(F.broadcast(whole)).select("_source", "n_docs", rate.alias("rate"))


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", targets: dict[str, float] | None = None, flatten: float = FLATTEN, total: float = 1.0, seed: str = "mix") -> DataFrame:
    """The columns of docs, then copy_no (from 1), shuffle_key and rate; rows in the shuffled order.

    Each document's count is the smallest k whose Poisson cdf at its source's rate exceeds a
    uniform number hashed from seed, id and source; so counts are the same wherever and however often
    a task runs. Rows are exploded by their count and sorted by a hash of seed, id and copy over
    all partitions; equal hashes go by the id's text, and rows that repeat an id come in any order. Long
    texts are moved once and never read. Equal rows get equal counts; a null id or source hashes as an empty text, a
    null source is a source of its own; an empty table gives no row. Columns named like the new
    ones are kept under their names, and the new ones are then left out.
    """
    rates = keep(source_rates(docs, source_col, targets, flatten, total))
    cdfs = poisson_counts(rates)
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # so that no column's name can clash
    keyed = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), source.alias("_source"), uniform(F.lit(seed), F.col(f"`{id_col}`"), source).alias("u"))
    # One row a source, 8 bytes for each count within reach of its rate: broadcast while sources are few, else joined by Spark's choice.
    met = keyed.join(F.broadcast(cdfs) if rates.count() <= 10_000 else cdfs, "_source")
    count = F.col("_from") + F.size(F.filter("_cdf", lambda c: c <= F.col("u")))
    copies = met.withColumn("count", count).filter("count > 0").withColumn("copy", F.explode(F.expr("sequence(1, count)")))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("id", F.lit("")), F.col("copy").cast("string")).cast("binary")), 1, 15)
    copies = copies.withColumn("order", F.conv(digits, 16, 10).cast("long"))
    # The keys are uniform on [0, 16 ** 15): equal ranges are equal shares, and no sampling pass is needed.
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.least(F.floor(F.col("order") / float(16**15) * parts), F.lit(parts - 1)).cast("int")
    mixed = copies.repartitionById(parts, part).sortWithinPartitions("order", "id")
    new = {"copy_no": F.col("copy").cast("long"), "shuffle_key": F.col("order"), "rate": F.col("_rate")}
    return mixed.select("row.*", *(v.alias(k) for k, v in new.items() if k not in docs.columns))
