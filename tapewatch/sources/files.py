"""Readers and writers: event JSON, labelled CSV and JSON, market CSV, alert tables, and Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.storage import numbered

ORDER_CSV = "order_id string, account_id string, instrument_id string, side string, price double, qty bigint, order_type string, timestamp_ns bigint, status string, venue string, gt_pattern string, gt_scenario_id string, gt_severity double"
EXECUTION_CSV = "trade_id string, order_id string, account_id string, instrument_id string, price double, qty bigint, timestamp_ns bigint, counterparty_account_id string, venue string, gt_pattern string, gt_scenario_id string, gt_severity double"
ORDER_JSON = ("order_id", "account_id", "instrument_id", "side", "price", "qty", "order_type", "timestamp_ns", "status", "venue", "orig_order_id")
EXECUTION_JSON = ("trade_id", "order_id", "account_id", "instrument_id", "side", "price", "qty", "timestamp_ns", "counterparty_account_id", "venue")
EVENT_JSON = "type string, order_id string, trade_id string, account_id string, counterparty_account_id string, instrument_id string, side string, price double, qty bigint, order_type string, timestamp_ns bigint, status string, venue string, orig_order_id string"


def encode_events(events: DataFrame) -> DataFrame:
    """value: each event as a flat JSON object with its type; fields of the other type are left out."""
    pick = lambda kind, cols: F.to_json(F.struct(F.lit(kind).alias("type"), *cols))
    return events.select(F.when(F.col("kind") == "order", pick("order", ORDER_JSON)).otherwise(pick("execution", EXECUTION_JSON)).alias("value"))


def decode_events(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """The events of JSON objects, and error where one is malformed or lacks a field of its type."""
    e = F.from_json(F.col(value_col).cast("string"), EVENT_JSON + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(F.col(value_col).alias("_raw"), e.alias("_e"))
    cols = [c.split()[0] for c in EVENT_JSON.split(", ")]
    out = rows.select("_raw", *(F.col(f"_e.{c}").alias(c) for c in cols), F.col("_e._bad").alias("_bad"))
    missing = lambda names: F.concat_ws(",", *(F.when(F.col(c).isNull(), c) for c in names))
    lacks = F.when(F.col("type") == "order", missing(ORDER_JSON)).when(F.col("type") == "execution", missing(EXECUTION_JSON))
    error = F.when(F.col("_bad").isNotNull(), "malformed").when(lacks.isNull(), "unknown type").when(lacks != "", F.concat(F.lit("missing "), lacks))
    return out.withColumns({"error": error, "kind": F.col("type")}).drop("_bad")


def split_errors(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those to be put aside."""
    return decoded.filter("error is null").drop("error", "_raw"), decoded.filter("error is not null").select("_raw", "error")


def read_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ORDER_CSV, header=True, mode="FAILFAST", quote='"', escape='"', enforceSchema=False)


def read_executions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=EXECUTION_CSV, header=True, mode="FAILFAST", quote='"', escape='"', enforceSchema=False)


def write_labelled_csv(rows: DataFrame, path: str) -> None:
    """Orders or executions with their labels; prices and severities have eight decimals."""
    names = [c.split()[0] for c in (ORDER_CSV if "status" in rows.columns else EXECUTION_CSV).split(", ")]
    fixed = rows.select(*(F.format_string("%.8f", c).alias(c) if c in ("price", "gt_severity") else F.col(c) for c in names))
    fixed.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


LABELLED = "ground_truth_label struct<pattern:string,scenario_id:string,severity:double>"


def read_labelled_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The orders and executions of {"orders": [...], "executions": [...]} files."""
    struct = lambda ddl: ", ".join(c for c in ddl.split(", ") if not c.startswith("gt_")).replace(" ", ":").replace(",:", ",")
    label = LABELLED.replace(" ", ":", 1)
    schema = f"orders array<struct<{struct(ORDER_CSV)},{label}>>, executions array<struct<{struct(EXECUTION_CSV)},{label}>>"
    whole = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")

    def rows(name: str) -> DataFrame:
        flat = whole.select(F.explode(name).alias("r")).select("r.*")
        return flat.withColumns({"gt_pattern": F.col("ground_truth_label.pattern"), "gt_scenario_id": F.col("ground_truth_label.scenario_id"), "gt_severity": F.col("ground_truth_label.severity")}).drop("ground_truth_label")

    return rows("orders"), rows("executions")


def labelled_lines(rows: DataFrame) -> DataFrame:
    """value: each order or execution as JSON with its label nested, one a line."""
    plain = [c for c in rows.columns if not c.startswith("gt_")]
    label = F.struct(F.col("gt_pattern").alias("pattern"), F.col("gt_scenario_id").alias("scenario_id"), F.col("gt_severity").alias("severity"))
    return rows.select(F.to_json(F.struct(*plain, label.alias("ground_truth_label"))).alias("value"))


def labelled_documents(orders: DataFrame, executions: DataFrame, documents: int) -> DataFrame:
    """part and value: so many JSON objects {"orders": [...], "executions": [...]}, which share all rows by the hash of their order's id.

    Readers take one object a file, so write them partitioned by part.
    """
    part = F.pmod(F.xxhash64("order_id"), F.lit(documents)).alias("part")
    none = F.lit(None).cast("string")
    lines = labelled_lines(orders.withColumn("part", part)).select("value", none.alias("done")), labelled_lines(executions.withColumn("part", part)).select(none.alias("value"), F.col("value").alias("done"))
    both = lines[0].unionByName(lines[1])
    number = F.get_json_object(F.coalesce("value", "done"), "$.part")
    whole = both.groupBy(number.alias("part")).agg(F.array_join(F.collect_list("value"), ",").alias("o"), F.array_join(F.collect_list("done"), ",").alias("e"))
    return whole.select("part", F.concat(F.lit('{"orders": ['), "o", F.lit('], "executions": ['), "e", F.lit("]}")).alias("value"))


def time_us(text) -> F.Column:
    """HH:MM:SS with decimals as microseconds of the day; further decimals are cut."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)(?:\.(\d+))?$", i)
    whole = part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")
    return whole * 1_000_000 + F.rpad(F.substring(part(4), 1, 6), 6, "0").cast("long")


def read_market_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """trades (symbol, date, time_us, price, size) or quotes (symbol, date, time_us, bid, ask, bidsiz, asksiz); sizes may be missing."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    base = [F.col("sym_root").alias("symbol"), "date", time_us(F.col("time_m")).alias("time_us")]
    if kind == "trades":
        return raw.select(*base, number("price"), number("size"), *(c for c in ("tr_corr", "tr_scond") if c in raw.columns), F.monotonically_increasing_id().alias("trade_no"))
    return raw.select(*base, number("bid"), number("ask"), *(number(c) if c in raw.columns else F.lit(1.0).alias(c) for c in ("bidsiz", "asksiz")))


def sized(rows: DataFrame, *sizes: str) -> tuple[DataFrame, DataFrame]:
    """Rows with every size above 0, and a one-row table of how many were dropped."""
    ok = F.lit(True)
    for s in sizes:
        ok = ok & F.coalesce(F.col(s) > 0, F.lit(False))
    return rows.filter(ok), rows.agg(F.count_if(~ok).alias("dropped"))


def with_event_time(rows: DataFrame, ns_col: str = "timestamp_ns") -> DataFrame:
    """rows with event_time (microseconds) and event_date, the partition column."""
    us = F.floor(F.col(ns_col) / 1000).cast("long") if ns_col is None else F.expr(f"({ns_col} - pmod({ns_col}, 1000)) div 1000")
    return rows.withColumn("event_time", F.timestamp_micros(us)).withColumn("event_date", F.to_date("event_time"))


def append_events(rows: DataFrame, path: str) -> None:
    with_event_time(rows).write.mode("append").partitionBy("event_date").parquet(path)


def append_alerts(alerts: DataFrame, path: str, order: list) -> None:
    """Store alerts after those that path has: ids go on from the largest, in the given order."""
    spark = alerts.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("alert_id")).first()[0] or 0
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        last = 0
    rows = with_event_time(numbered(alerts, order, "alert_id", last + 1), "window_end_ns")
    rows.write.mode("append").partitionBy("event_date").parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The topic from its beginning as a stream of value; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}).load().selectExpr("cast(value as string) as value")


def write_kafka(lines: DataFrame, servers: str, topic: str) -> None:
    lines.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def read_reports(spark: SparkSession, **paths: str) -> DataFrame:
    """One row with a struct for each named JSON file."""
    out = None
    for name, path in paths.items():
        one = spark.read.json(path, multiLine=True).limit(1)  # a report is one object
        one = one.select(F.struct(*one.columns).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out
