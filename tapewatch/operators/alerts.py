"""The alert store: filters, pages, case status, severity, and evidence read back into fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.functions.schemas import CASE_STATUSES

#: Which status a case may be moved to from each status in the user interface.
NEXT = {"OPEN": ("UNDER_REVIEW", "ESCALATED", "CLOSED"), "UNDER_REVIEW": ("ESCALATED", "CLOSED"), "ESCALATED": ("CLOSED",), "CLOSED": ("OPEN",)}
#: Lower ends of the severity bands.
SEVERITY = ((0.85, "Critical"), (0.65, "Serious"), (0.4, "Warning"))


def find_alerts(alerts: DataFrame, account: str | None = None, detector: str | None = None, start_ns: int | None = None, end_ns: int | None = None, alert_id: int | None = None) -> DataFrame:
    """Alerts that meet all given conditions; conditions not given leave no trace in the plan."""
    if alert_id is not None:
        alerts = alerts.filter(F.col("alert_id") == alert_id)
    if account is not None:
        alerts = alerts.filter(F.array_contains("account_ids", account))
    if detector is not None:
        alerts = alerts.filter(F.col("detector_name") == detector)
    if start_ns is not None:
        alerts = alerts.filter(F.col("window_start_ns") >= start_ns)
    if end_ns is not None:
        alerts = alerts.filter(F.col("window_start_ns") <= end_ns)
    return alerts


def recent_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """The latest alerts by the order in which they were stored."""
    return alerts.orderBy(F.desc("alert_id")).limit(limit)


def alerts_page(alerts: DataFrame, offset: int, limit: int, **conditions) -> DataFrame:
    """A page of the latest alerts, each row with the number of all that meet the conditions."""
    found = find_alerts(alerts, **conditions)
    total = found.agg(F.count(F.lit(1)).alias("total_count"))  # one row
    return found.orderBy(F.desc("alert_id")).offset(offset).limit(limit).join(F.broadcast(total))


def dispatch(alerts: DataFrame, offset: int | None = None, limit: int = 50, account: str | None = None, detector: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """The query that a request's parameters ask for: a page, or one of account, detector, range and recency."""
    if offset is not None:
        return alerts_page(alerts, offset, limit, account=account, detector=detector)
    if account is not None:
        return find_alerts(alerts, account=account).orderBy("alert_id")
    if detector is not None:
        return find_alerts(alerts, detector=detector).orderBy("alert_id")
    if start_ns is not None or end_ns is not None:
        return find_alerts(alerts, start_ns=start_ns, end_ns=end_ns).orderBy("window_start_ns")
    return recent_alerts(alerts, limit)


def search_alerts(alerts: DataFrame, needle: str) -> DataFrame:
    """Alerts whose detector, instrument or any account holds needle, upper and lower case alike."""
    n = needle.lower()
    return alerts.filter(F.contains(F.lower("detector_name"), F.lit(n)) | F.contains(F.lower("instrument_id"), F.lit(n)) | F.exists("account_ids", lambda a: F.contains(F.lower(a), F.lit(n))))


def severity(score: Column) -> Column:
    out = F.lit("Low")
    for least, name in reversed(SEVERITY):
        out = F.when(score >= least, name).otherwise(out)
    return out


def latest_status(alerts: DataFrame, status_log: DataFrame) -> DataFrame:
    """alerts with the last status of status_log (alert_id, version, status), OPEN where there is none."""
    last = status_log.groupBy("alert_id").agg(F.max_by("status", "version").alias("status"))
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("status", F.lit("OPEN")))


def status_changes(changes: DataFrame, alerts: DataFrame) -> DataFrame:
    """changes (alert_id, version, status) with error: an unknown alert, an unknown status, or null."""
    known = alerts.select("alert_id", F.lit(True).alias("_known"))
    error = F.when(F.col("_known").isNull(), "no such alert").when(~F.col("status").isin(*CASE_STATUSES), "no such status")
    return changes.join(known, "alert_id", "left").withColumn("error", error).drop("_known")


def allowed_next(status: Column) -> Column:
    return F.element_at(F.create_map(*(x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), status)


def duration_text(ns: Column) -> Column:
    """Nanoseconds as ns, µs, ms or s."""
    two = lambda x: F.format_string("%.2f", x)
    return F.when(ns < 1_000, F.concat(ns.cast("string"), F.lit("ns"))).when(ns < 1_000_000, F.concat(two(ns / 1e3), F.lit("µs"))).when(ns < 1_000_000_000, F.concat(two(ns / 1e6), F.lit("ms"))).otherwise(F.concat(two(ns / 1e9), F.lit("s")))


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.concat(F.regexp_replace(F.format_string(f"%.{digits}f", x * 100), r"\.0+$", ""), F.lit("%"))


#: The fixed forms of the detectors' evidence, with the fields that they hold.
EVIDENCE = {
    "SpoofingLayeringDetector": (
        r"^depth_ratio=([\d.]+) speed=([\d.]+) opposite_price_moved_favorably=(true|false) move_score=([\d.]+) concurrent_same_side_orders=(\d+) typical_concurrent=([\d.]+) layering_score=([\d.]+) time_in_book_ns=(\d+)$",
        ("depth_ratio", "speed", "moved", "move_score", "concurrent", "typical_concurrent", "layering_score", "time_in_book_ns"),
    ),
    "MarkingTheCloseDetector": (r"^account-group closing-window volume=(\d+) / total=(\d+) \(share=([\d.]+), group_size=(\d+)\)$", ("group_qty", "total_qty", "share", "group_size")),
    "StatisticalBaselineDetector": (r"^order qty=(\d+) z=([\d.-]+) against running mean=([\d.]+) stddev=([\d.]+) \(n=(\d+)\)$", ("qty", "z", "mean", "stddev", "n")),
    "MlAnomalyDetector": (r"^Isolation Forest anomaly_score=([\d.]+) model_version=(.+)$", ("anomaly_score", "model_version")),
}


def parse_evidence(detector: Column, evidence: Column) -> Column:
    """The evidence's fields as a map of strings; null where the text hasn't its detector's form."""
    out = F.lit(None).cast("map<string,string>")
    for name, (pattern, fields) in EVIDENCE.items():
        pairs = [x for i, f in enumerate(fields) for x in (F.lit(f), F.regexp_extract(evidence, pattern, i + 1))]
        out = F.when((detector == name) & evidence.rlike(pattern), F.create_map(*pairs)).otherwise(out)
    return out


def readable_gap(evidence: Column) -> Column:
    """The evidence with its "...ns after" as a readable duration."""
    ns = F.regexp_extract(evidence, r"(\d+)ns after", 1)
    return F.when(ns == "", evidence).otherwise(F.concat(F.regexp_extract(evidence, r"^(.*?)\d+ns after", 1), duration_text(ns.cast("long")), F.regexp_extract(evidence, r"\d+ns( after.*)$", 1)))


def timeline(alerts: DataFrame) -> DataFrame:
    """Each alert's place between the first (0) and the last (1)."""
    ends = alerts.agg(F.min("window_start_ns").alias("_first"), F.max("window_start_ns").alias("_last"))  # one row
    at = F.when(F.col("_last") == F.col("_first"), F.lit(0.0)).otherwise((F.col("window_start_ns") - F.col("_first")) / (F.col("_last") - F.col("_first")))
    return alerts.join(F.broadcast(ends)).withColumn("position", at).drop("_first", "_last")


def per_detector(alerts: DataFrame) -> DataFrame:
    w = Window.partitionBy("detector_name").orderBy("alert_id")
    return alerts.withColumn("n_in_detector", F.row_number().over(w))


def pg_array(values: Column) -> Column:
    """A text[] literal: every element quoted, quotes and backslashes escaped."""
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def from_pg_array(text: Column) -> Column:
    """The elements of a text[] literal that pg_array() made."""
    parts = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"\\(.)", "$1"))


def alert_json(alerts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """alert_id and json; fields without a value are written as null."""
    cols = fields or alerts.columns
    return alerts.select("alert_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
