"""Reports as JSON, the store's tables, and the state of the system."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.schemas import CASE_STATUSES, DETECTORS

ALERT_TABLE = "alert_id bigint, detector_name string, score double, instrument_id string, account_ids array<string>, order_ids array<string>, window_start_ns bigint, window_end_ns bigint, evidence string, model_version string, book_snapshot_sequence bigint, event_time timestamp, event_date date"
ORDER_TABLE = "order_id string, account_id string, instrument_id string, side string, price double, qty bigint, order_type string, timestamp_ns bigint, status string, venue string, orig_order_id string, event_time timestamp, event_date date"
TRADE_TABLE = "trade_id string, order_id string, account_id string, instrument_id string, side string, price double, qty bigint, timestamp_ns bigint, counterparty_account_id string, venue string, event_time timestamp, event_date date"
TABLES = {"orders": ORDER_TABLE, "trades": TRADE_TABLE, "alerts": ALERT_TABLE}


def create_tables(spark: SparkSession, database: str) -> None:
    """The store's tables, partitioned by date; those that exist are left alone."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet PARTITIONED BY (event_date)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.alert_status (alert_id bigint, version bigint, status string) USING json")


def empty_tables(spark: SparkSession, database: str) -> None:
    for name in (*TABLES, "alert_status"):
        spark.sql(f"TRUNCATE TABLE {database}.{name}")


def alive(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1").first()[0] == 1


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; False if it does. Of several writers one succeeds, as the store creates it exclusively."""
    if path.startswith("file:"):
        local = path.removeprefix("file:")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    out.write(text.encode())
    out.close()
    return True


def set_status(spark: SparkSession, database: str, alert_id: int, status: str, tries: int = 1000) -> int:
    """Append a case's new status and return its version; ValueError for an unknown status, KeyError for an unknown alert.

    Each version of a case is a file of the table alert_status, named by both. A writer that finds that another one took the version
    after the last takes the next one, so that no change is lost and none overwrites another.
    """
    if status not in CASE_STATUSES:
        raise ValueError(f"no such status: {status}")
    if not spark.table(f"{database}.alerts").filter(F.col("alert_id") == alert_id).limit(1).count():
        raise KeyError(alert_id)
    name = f"{database}.alert_status"
    folder = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first().data_type
    spark.catalog.refreshTable(name)
    version = spark.table(name).filter(F.col("alert_id") == alert_id).agg(F.max("version")).first()[0] or 0
    for _ in range(tries):
        version += 1
        if created(spark, f"{folder}/case-{alert_id}-{version}.json", json.dumps({"alert_id": alert_id, "version": version, "status": status})):
            spark.catalog.refreshTable(name)
            return version
    raise RuntimeError(f"no free version for alert {alert_id} after {tries} tries")


def system_status(alerts: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One row: stored alerts, the detectors and how many alerts each has, and the scorer's version."""
    counts = alerts.groupBy("detector_name").agg(F.count(F.lit(1)).alias("n"))
    per = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_alerts"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("detector_name", "n")))).alias("by_detector"))  # six detectors
    version = scored.agg(F.max("model_version").alias("model_version")) if scored is not None else per.sparkSession.range(1).select(F.lit(None).cast("string").alias("model_version"))
    return per.join(F.broadcast(version)).withColumn("detectors", F.lit(list(DETECTORS)))


def six_decimals(c: str) -> Column:
    return F.format_string("%.6f", c).cast("decimal(38,6)").alias(c)


def evaluation_json(matrix: DataFrame) -> DataFrame:
    """json: each detector's counts and rates; rates have six decimals, or are null where undefined."""
    rates = [F.when(F.col(c).isNotNull(), F.round(F.col(c).cast("decimal(20,10)"), 6)).alias(c) for c in ("precision", "recall", "f1")]
    return matrix.select(F.to_json(F.struct("detector_name", "tp", "fp", "fn", "tn", *rates), {"ignoreNullFields": "false"}).alias("json"))


def depth_json(snapshots: DataFrame) -> DataFrame:
    """Snapshots (JSON text) as nested columns, best prices first."""
    from tapewatch.functions.schemas import SNAPSHOT

    return snapshots.select(F.from_json("snapshot", SNAPSHOT).alias("s")).select("s.*")


def facts_json(**parts: DataFrame) -> DataFrame:
    """One row of JSON with each statistic's rows as a list: for aggregates, whose size does not grow with the market."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def account_cancels(events: DataFrame, account: str) -> DataFrame:
    return events.filter((F.col("account_id") == account) & (F.col("status") == "Cancelled")).agg(F.count(F.lit(1)).alias("n_cancels"))


def latency(spans: DataFrame, column: str) -> DataFrame:
    """Mean, median, 99th percentile and largest of a column of durations."""
    return spans.agg(F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.99).alias("p99"), F.max(column).alias("max"))
