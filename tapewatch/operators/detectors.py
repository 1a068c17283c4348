"""Detectors as joins and windows. Events carry (timestamp_ns, is_exec, idx) as their total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.functions.running import running_sums, with_position
from tapewatch.functions.scalars import fixed6
from tapewatch.functions.schemas import require_unlabelled
from tapewatch.functions.storage import keep
from tapewatch.operators import anomaly, book, book_sets
from tapewatch.operators.relations import account_components, is_related, relation_keys

ORDER_COLS = ("timestamp_ns", "is_exec", "idx")
#: Events of an instrument that one task may replay: its state grows with the orders that rest, so this bounds a task's Python memory.
KEYED_EVENTS = 1_000_000


def alert(name: str, **columns) -> list[Column]:
    """The alert columns; those not given are null."""
    given = {"detector_name": F.lit(name), "model_version": F.lit(None).cast("string"), "book_snapshot_sequence": F.lit(None).cast("long"), **columns}
    order = ("detector_name", "score", "instrument_id", "account_ids", "order_ids", "window_start_ns", "window_end_ns", "evidence", "model_version", "book_snapshot_sequence")
    return [given[c].alias(c) for c in order]


def with_sequence(events: DataFrame) -> DataFrame:
    """events with sequence, their number in their instrument's book: null where the caller has none."""
    return events if "sequence" in events.columns else events.withColumn("sequence", F.lit(None).cast("long"))


def wash_trades(executions: DataFrame, entities: DataFrame) -> DataFrame:
    """Executions whose two accounts are related; two joins with the account table."""
    require_unlabelled(executions)
    side = lambda p: entities.select(F.col("account_id").alias(f"_{p}"), F.col("owner_id").alias(f"_{p}_owner"), F.col("linked_account_ids").alias(f"_{p}_links"))
    rows = with_sequence(executions).filter(F.coalesce("counterparty_account_id", F.lit("")) != "")
    rows = rows.join(side("a"), F.col("account_id") == F.col("_a"), "left").join(side("b"), F.col("counterparty_account_id") == F.col("_b"), "left")
    hit = rows.filter(is_related(F.col("account_id"), F.col("counterparty_account_id"), F.col("_a_owner"), F.col("_b_owner"), F.col("_a_links"), F.col("_b_links")))
    said = F.concat(F.lit("Execution "), "trade_id", F.lit(" matched account "), "account_id", F.lit(" against related counterparty "), "counterparty_account_id", F.lit(" (same beneficial owner, explicit link, or self-trade)"))
    return hit.select(*alert("WashTradeDetector", score=F.lit(1.0), instrument_id=F.col("instrument_id"), account_ids=F.array("account_id", "counterparty_account_id"), order_ids=F.array("order_id", "trade_id"), window_start_ns=F.col("timestamp_ns"), window_end_ns=F.col("timestamp_ns"), evidence=said, book_snapshot_sequence=F.col("sequence")), *ORDER_COLS, F.lit(0).alias("emission"))


def running_stats(new_orders: DataFrame) -> DataFrame:
    """new_orders with n, mean and sd of the earlier quantities of the account in the instrument."""
    before = Window.partitionBy("account_id", "instrument_id").orderBy("timestamp_ns", "idx").rowsBetween(Window.unboundedPreceding, -1)
    return new_orders.withColumns({"n": F.count("qty").over(before), "mean": F.avg("qty").over(before), "sd": F.stddev_samp("qty").over(before)})


def zscore_alerts(new_orders: DataFrame, threshold: float = 3.0, min_samples: int = 5) -> DataFrame:
    """Orders whose quantity lies threshold deviations off the account's earlier mean."""
    require_unlabelled(new_orders)
    rows = running_stats(with_sequence(new_orders)).filter((F.col("n") >= min_samples) & (F.col("sd") > 0)).withColumn("z", (F.col("qty") - F.col("mean")) / F.col("sd"))
    hit = rows.filter(F.abs("z") >= threshold)
    said = F.concat(F.lit("order qty="), F.col("qty").cast("string"), F.lit(" z="), fixed6(F.col("z")), F.lit(" against running mean="), fixed6(F.col("mean")), F.lit(" stddev="), fixed6(F.col("sd")), F.lit(" (n="), F.col("n").cast("string"), F.lit(")"))
    return hit.select(*alert("StatisticalBaselineDetector", score=F.least(F.abs("z") / (2 * threshold), F.lit(1.0)), instrument_id=F.col("instrument_id"), account_ids=F.array("account_id"), order_ids=F.array("order_id"), window_start_ns=F.col("timestamp_ns"), window_end_ns=F.col("timestamp_ns"), evidence=said, book_snapshot_sequence=F.col("sequence")), *ORDER_COLS, F.lit(0).alias("emission"))


def front_running(new_orders: DataFrame, entities: DataFrame, window_ns: int = 2_000_000_000, large_qty: int = 1000, ratio: float = 0.2) -> DataFrame:
    """Small orders of a related account within window_ns after a large one on the same side.

    A join on (instrument, side, relation key, time bucket): each order looks into its own bucket
    of window_ns and the one before. For times that don't go back within an instrument and side.
    """
    require_unlabelled(new_orders)
    keys = relation_keys(entities).withColumnRenamed("key", "rel")
    cols = ("order_id", "account_id", "qty", "timestamp_ns", "idx")
    keyed = with_sequence(new_orders).select("instrument_id", "side", *cols, "is_exec", "sequence").join(keys, "account_id")
    bucket = F.expr(f"timestamp_ns div {window_ns}")
    prior = keyed.filter(F.col("qty") >= large_qty).select("instrument_id", "side", "rel", bucket.alias("bucket"), *(F.col(c).alias(f"p_{c}") for c in cols))
    small = keyed.withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
    gap = F.col("timestamp_ns") - F.col("p_timestamp_ns")
    later = (gap > 0) | ((gap == 0) & (F.col("idx") > F.col("p_idx")))
    met = small.join(prior, ["instrument_id", "side", "rel", "bucket"]).filter(later & (gap <= window_ns) & (F.col("account_id") != F.col("p_account_id")) & (F.col("qty") <= ratio * F.col("p_qty")))
    met = met.dropDuplicates(["order_id", "p_order_id"])  # accounts may share several keys
    said = F.concat(
        F.lit("related account "), "account_id", F.lit(" placed order "), "order_id", F.lit(" (qty="), F.col("qty").cast("string"), F.lit(") "), gap.cast("string"),
        F.lit("ns after a large same-side order "), "p_order_id", F.lit(" (qty="), F.col("p_qty").cast("string"), F.lit(") from related account "), "p_account_id",
    )
    order = Window.partitionBy("order_id").orderBy("p_timestamp_ns", "p_idx")
    return met.select(*alert("FrontRunningDetector", score=F.lit(1.0), instrument_id=F.col("instrument_id"), account_ids=F.array("p_account_id", "account_id"), order_ids=F.array("p_order_id", "order_id"), window_start_ns=F.col("p_timestamp_ns"), window_end_ns=F.col("timestamp_ns"), evidence=said, book_snapshot_sequence=F.col("sequence")), *ORDER_COLS, (F.row_number().over(order) - 1).alias("emission"))


def closing_legs(executions: DataFrame, entities: DataFrame, close: DataFrame, window_ns: int = 300_000_000_000) -> DataFrame:
    """The legs of executions in [close - window, close]: leg 0 is the account, leg 1 another counterparty.

    close has instrument_id and session_close_ns. Each leg gets its account's component, when that
    account was first seen (over all instruments), and the running volumes of its check, which are summed by
    blocks of an instrument's legs, so that no task has all of them.
    """
    rows = with_sequence(executions).join(close, "instrument_id").filter((F.col("timestamp_ns") <= F.col("session_close_ns")) & (F.col("timestamp_ns") >= F.col("session_close_ns") - window_ns))
    other = (F.coalesce("counterparty_account_id", F.lit("")) != "") & (F.col("counterparty_account_id") != F.col("account_id"))
    accounts = F.when(other, F.array("account_id", "counterparty_account_id")).otherwise(F.array("account_id"))
    legs = rows.select("instrument_id", "trade_id", "qty", *ORDER_COLS, "sequence", (F.col("session_close_ns") - window_ns).alias("window_start_ns"), F.posexplode(accounts).alias("leg", "account"))
    groups = account_components(entities).withColumnRenamed("account_id", "account")
    legs = legs.join(groups, "account", "left").withColumn("component", F.coalesce("component_id", "account")).drop("component_id")
    at = F.struct("timestamp_ns", "idx", "leg")
    first = legs.groupBy("account").agg(F.min(at).alias("first_seen"))
    legs = legs.join(first, "account").withColumn("at", at)
    # The other leg of the same execution, if it is of the same group.
    pair = Window.partitionBy("instrument_id", "component", *ORDER_COLS).orderBy("leg")
    twin = F.coalesce(F.lead("first_seen").over(pair) < F.col("at"), F.lit(False)) & (F.col("leg") == 0)
    legs = legs.withColumns({"_twin": F.when(twin, F.col("qty")).otherwise(0), "_traded": F.when(F.col("leg") == 0, F.col("qty")).otherwise(0)})
    legs = with_position(legs, ["instrument_id"], ["timestamp_ns", "idx", "leg"], "_place")
    legs = keep(running_sums(legs, ["instrument_id"], "_place", {"total_qty": "_traded"}))
    legs = running_sums(legs, ["instrument_id", "component"], "_place", {"group_qty": "qty"})
    # At leg 0 the other leg's volume is credited already, and counts if its account was seen before.
    legs = legs.withColumn("group_qty", F.col("group_qty") + F.col("_twin")).drop("_twin", "_traded", "_place")
    return legs.withColumn("share", F.col("group_qty") / F.col("total_qty"))


def marking_the_close(executions: DataFrame, entities: DataFrame, close: DataFrame, window_ns: int = 300_000_000_000, share: float = 0.4, min_group: int = 100, min_total: int = 500) -> DataFrame:
    """The first check of each account group in each instrument whose share of the closing volume is large."""
    require_unlabelled(executions)
    legs = keep(closing_legs(executions, entities, close, window_ns))  # read four times below
    passed = legs.filter((F.col("group_qty") >= min_group) & (F.col("total_qty") >= min_total) & (F.col("share") >= share))
    fired = passed.groupBy("instrument_id", "component").agg(F.min_by(F.struct(*(c for c in passed.columns if c not in ("instrument_id", "component"))), "at").alias("f")).select("instrument_id", "component", "f.*")
    names = fired.select("instrument_id", "component", F.col("at").alias("fired_at"))
    seen = legs.select("component", "account", "first_seen").distinct()
    members = names.join(seen, "component").filter(F.col("first_seen") <= F.col("fired_at")).groupBy("instrument_id", "component").agg(F.sort_array(F.collect_set("account")).alias("members"))
    counted = names.join(legs.select("instrument_id", "component", "account", "at", "first_seen", "trade_id", "leg", "timestamp_ns", "idx"), ["instrument_id", "component"])
    # Credited by the check: legs up to it, and the other leg of its own execution; of accounts seen by then.
    credited = (F.struct("timestamp_ns", "idx") <= F.struct("fired_at.timestamp_ns", "fired_at.idx")) & (F.col("first_seen") <= F.col("fired_at"))
    trades = counted.filter(credited).groupBy("instrument_id", "component").agg(F.transform(F.sort_array(F.collect_list(F.struct("account", "at", "trade_id"))), lambda x: x["trade_id"]).alias("trades"))
    rows = fired.join(members, ["instrument_id", "component"]).join(trades, ["instrument_id", "component"])
    said = F.concat(F.lit("account-group closing-window volume="), F.col("group_qty").cast("string"), F.lit(" / total="), F.col("total_qty").cast("string"), F.lit(" (share="), fixed6(F.col("share")), F.lit(", group_size="), F.size("members").cast("string"), F.lit(")"))
    return rows.select(*alert("MarkingTheCloseDetector", score=F.least("share", F.lit(1.0)), instrument_id=F.col("instrument_id"), account_ids=F.col("members"), order_ids=F.col("trades"), window_start_ns=F.col("window_start_ns"), window_end_ns=F.col("timestamp_ns"), evidence=said, book_snapshot_sequence=F.col("sequence")), *ORDER_COLS, F.col("leg").alias("emission"))


def placed(found: DataFrame, events: DataFrame) -> DataFrame:
    """found (with seq) with the order columns and the sequence of the event that it came from."""
    return found.join(with_sequence(events).select("seq", *ORDER_COLS, "sequence"), "seq")


def spoof_scores(events: DataFrame, threshold: float = 0.6, most: int = KEYED_EVENTS) -> DataFrame:
    """book.SCORES of events (read several times) with seq. Both ways give the same rows.

    An instrument of up to most events is replayed by one task's keyed state, which is the shorter way. Those with more are so few that their
    names are broadcast, and go by joins and sums that all tasks share; in them time must not go back.
    """
    hot = keep(events.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("instrument_id"))
    if not hot.limit(1).count():
        return book.replay(events, "scores", threshold)
    sets = book_sets.spoof_scores(events.join(F.broadcast(hot), "instrument_id", "left_semi"), threshold)
    return book.replay(events.join(F.broadcast(hot), "instrument_id", "left_anti"), "scores", threshold).unionByName(sets)


def spoofing(events: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Alerts of spoofing and layering over events with seq."""
    rows = placed(spoof_scores(events, threshold).filter("fired"), events)
    return rows.select(*alert("SpoofingLayeringDetector", score=F.col("score"), instrument_id=F.col("instrument_id"), account_ids=F.array("account_id"), order_ids=F.array("order_id"), window_start_ns=F.col("window_start_ns"), window_end_ns=F.col("window_end_ns"), evidence=F.col("evidence"), book_snapshot_sequence=F.col("book_snapshot_sequence")), *ORDER_COLS, F.lit(0).alias("emission"))


def anomalies(events: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Alerts of the isolation forest over the flow windows of events with seq."""
    found = anomaly.anomaly_alerts(anomaly.score_features(anomaly.flow_features(events)), threshold)
    rows = placed(found, events)
    return rows.select(*alert("MlAnomalyDetector", **{c: F.col(c) for c in ("score", "instrument_id", "account_ids", "order_ids", "window_start_ns", "window_end_ns", "evidence", "model_version")}, book_snapshot_sequence=F.col("sequence")), *ORDER_COLS, F.lit(0).alias("emission"))


def union_alerts(*parts: DataFrame) -> DataFrame:
    """All detectors' alerts in one table, with the detectors' order as detector_ord."""
    from tapewatch.functions.schemas import DETECTORS

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.array_position(F.lit(list(DETECTORS)), F.col("detector_name"))
    return out.withColumn("detector_ord", place.cast("long"))
