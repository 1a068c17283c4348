"""Row types (as DDL) of orders, executions, accounts, alerts and book snapshots, and their fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame

SIDES, ORDER_TYPES, STATUSES = ("Buy", "Sell"), ("Limit", "Market"), ("New", "Cancelled", "Replaced")
PATTERNS = ("None", "WashTrade", "SpoofingLayering", "MarkingTheClose", "FrontRunning")
CASE_STATUSES = ("OPEN", "UNDER_REVIEW", "ESCALATED", "CLOSED")
#: Detectors in the order in which they see an event.
DETECTORS = ("WashTradeDetector", "SpoofingLayeringDetector", "MarkingTheCloseDetector", "FrontRunningDetector", "StatisticalBaselineDetector", "MlAnomalyDetector")

ORDER = "order_id string, account_id string, instrument_id string, side string, price double, qty bigint, order_type string, timestamp_ns bigint, status string, venue string, orig_order_id string"
EXECUTION = "trade_id string, order_id string, account_id string, instrument_id string, side string, price double, qty bigint, timestamp_ns bigint, counterparty_account_id string, venue string"
LABEL = "pattern string, scenario_id string, severity double"
#: Orders and executions in one stream; seq is the total order in which they are processed.
EVENT = "seq bigint, kind string, order_id string, orig_order_id string, trade_id string, account_id string, counterparty_account_id string, instrument_id string, side string, price double, qty bigint, status string, timestamp_ns bigint"
ENTITY = "account_id string, owner_id string, entity_type string, linked_account_ids array<string>"
INSTRUMENT = "instrument_id string, symbol string, asset_class string, tick_size double, avg_daily_volume bigint, session_close_ns bigint"
ALERT = "detector_name string, score double, instrument_id string, account_ids array<string>, order_ids array<string>, window_start_ns bigint, window_end_ns bigint, evidence string, model_version string, book_snapshot_sequence bigint, seq bigint"
SNAPSHOT = (
    "instrument_id string, sequence bigint, last_event_timestamp_ns bigint, "
    "bids array<struct<price:double,total_qty:bigint,orders:array<struct<order_id:string,account_id:string,qty:bigint>>>>, "
    "asks array<struct<price:double,total_qty:bigint,orders:array<struct<order_id:string,account_id:string,qty:bigint>>>>"
)


def require_unlabelled(df: DataFrame) -> DataFrame:
    """df itself; fails if a ground-truth column would reach a detector."""
    bad = [c for c in df.columns if c.startswith("gt_") or c == "ground_truth_label"]
    if bad:
        raise ValueError(f"ground truth must not reach detectors: {bad}")
    return df
