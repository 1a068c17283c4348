"""An inverted index from accounts to the files that hold their alerts: a lookup reads one account's files only.

A folder holds alerts/batch=N (files clustered by the first account and time) and postings/batch=N/part=K (one row for each account and file, by a hash
of the account). A batch can be found once its postings are written, and one that runs again replaces both.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators.alerts import find_alerts

#: Parts of a batch's postings, alerts of one file, and files beyond which a lookup doesn't name them but reads the account's batches whole.
PARTS, FILE_ROWS, NAMED_FILES = 64, 200_000, 10_000


def add_batch(alerts: DataFrame, folder: str, batch: int, parts: int = PARTS, file_rows: int = FILE_ROWS, ranges: int | None = None) -> None:
    """Write one batch of alerts (with account_ids and window_start_ns) and its postings; an existing batch of that number is replaced.

    Alerts are range-partitioned by first account and time, so that an account with a large share of them is cut by time. Postings
    are counted by account and file before they are shuffled: an account has as many as there are files, however many alerts.
    """
    spark, place = alerts.sparkSession, f"{folder}/alerts/batch={batch}"
    by = [F.get("account_ids", F.lit(0)), F.col("window_start_ns")]
    ranged = alerts.repartitionByRange(ranges, *by) if ranges else alerts.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(place)
    held = spark.read.schema(alerts.schema).parquet(place).select(F.col("_metadata.file_name").alias("file"), "window_start_ns", F.explode(F.array_distinct("account_ids")).alias("account"))
    postings = held.filter("account IS NOT NULL").groupBy("account", "file").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.min("window_start_ns").alias("first_ns"), F.max("window_start_ns").alias("last_ns")
    )
    part = F.pmod(F.crc32(F.col("account").cast("binary")), F.lit(parts)).cast("int")
    rows = postings.withColumn("part", part).repartition("part").sortWithinPartitions("part", "account", "file")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings/batch={batch}")


def index_sink(folder: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A sink for streams of alerts: every micro-batch is a batch of the index, and one that runs again replaces its own."""
    return lambda batch, number: add_batch(batch, folder, number, parts)


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that a pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath().toString()) for f in found or [] if f.isDirectory())


POSTINGS = "account string, file string, n_alerts bigint, first_ns bigint, last_ns bigint, batch bigint, part int"


def postings(spark: SparkSession, folder: str, account: str | None = None, parts: int = PARTS) -> DataFrame:
    """The postings of all batches, or the rows of one account, for which one part of each batch is listed and read."""
    part = "*" if account is None else str(zlib.crc32(account.encode()) % parts)
    places = _folders(spark, f"{folder}/postings/batch=*/part={part}")
    if not places:
        return spark.createDataFrame([], POSTINGS)
    rows = spark.read.schema(POSTINGS).option("basePath", f"{folder}/postings").parquet(*places)
    return rows if account is None else rows.filter(F.col("account") == account)


def account_totals(spark: SparkSession, folder: str) -> DataFrame:
    """account, n_alerts, first_ns and last_ns from the postings alone; no alert is read."""
    return postings(spark, folder).groupBy("account").agg(F.sum("n_alerts").alias("n_alerts"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))


def account_alerts(spark: SparkSession, folder: str, schema, account: str, start_ns: int | None = None, end_ns: int | None = None, parts: int = PARTS, named_files: int = NAMED_FILES) -> DataFrame:
    """The account's alerts, in a range of start times if given, read from just the files that its postings name.

    schema is that of the alerts. An account without postings gives an empty table. An account in more than named_files files is looked up in
    the whole of its batches, so the driver never holds a longer list; the rows are the same.
    """
    found = postings(spark, folder, account, parts)
    if start_ns is not None:
        found = found.filter(F.col("last_ns") >= start_ns)
    if end_ns is not None:
        found = found.filter(F.col("first_ns") <= end_ns)
    named = found.select("batch", "file").limit(named_files + 1).collect()
    if len(named) <= named_files:
        places = sorted(f"{folder}/alerts/batch={r.batch}/{r.file}" for r in named)
    else:
        places = sorted(f"{folder}/alerts/batch={r.batch}" for r in found.select("batch").distinct().collect())  # one row a batch
    if not places:
        return spark.createDataFrame([], schema)
    return find_alerts(spark.read.schema(schema).parquet(*places), account=account, start_ns=start_ns, end_ns=end_ns)
