"""Queries over the order flow with replaces and rejected events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.storage import numbered
from tapewatch.operators import book, book_sets
from tapewatch.sources import adapter

BASE = adapter.AMENDED_SQL


def amended(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(adapter.amended_events(spark, sf), ["timestamp_ns", "is_exec", "idx"], "seq")


def amended_trace(spark, sf):
    return book_sets.trace(amended(spark, sf))


#: Level changes, their running totals, and the best prices among the levels that hold orders.
TRACE = """, chg AS (SELECT instrument_id, side, price, seq, CAST(sum(dq) AS BIGINT) AS dq, CAST(sum(dn) AS BIGINT) AS dn FROM (
  SELECT instrument_id, side, price, seq, 0 AS dq, 0 AS dn FROM aq
  UNION ALL SELECT instrument_id, side, tp, seq, -tq, -1 FROM aq WHERE tq IS NOT NULL
  UNION ALL SELECT instrument_id, side, ap, seq, aq, 1 FROM aq WHERE aq IS NOT NULL) x GROUP BY ALL),
run AS (SELECT *, CAST(sum(dq) OVER w AS BIGINT) AS level_qty, CAST(sum(dn) OVER w AS BIGINT) AS level_orders FROM chg WINDOW w AS (PARTITION BY instrument_id, side, price ORDER BY seq)),
grid AS (SELECT e.seq, l.side, l.price, sum(coalesce(c.dn, 0)) OVER (PARTITION BY e.instrument_id, l.side, l.price ORDER BY e.seq) AS n FROM aq e JOIN (SELECT DISTINCT instrument_id, side, price FROM chg) l ON e.instrument_id = l.instrument_id
  LEFT JOIN chg c ON c.instrument_id = l.instrument_id AND c.side = l.side AND c.price = l.price AND c.seq = e.seq),
bst AS (SELECT seq, max(CASE WHEN side = 'Buy' AND n > 0 THEN price END) AS best_bid, min(CASE WHEN side = 'Sell' AND n > 0 THEN price END) AS best_ask FROM grid GROUP BY 1)
SELECT e.instrument_id, e.seq, e.sequence, e.skipped, e.timestamp_ns, b.best_bid, b.best_ask, r.level_qty, r.level_orders
FROM aq e JOIN bst b ON e.seq = b.seq JOIN run r ON r.seq = e.seq AND r.instrument_id = e.instrument_id AND r.side = e.side AND r.price = e.price"""


def amended_queue(spark, sf):
    """The place in their level that replaces kept or lost."""
    return book_sets.queue(amended(spark, sf))


QUEUE = """, lst AS (SELECT a.*, CASE WHEN k IN (2, 3, 5) THEN 2 WHEN k = 4 THEN 3 ELSE 0 END AS since, q2 - CASE WHEN event_type = 'signup' THEN greatest(1, q2 // 2) ELSE 0 END AS remaining FROM am a WHERE event_type IN ('view', 'signup')),
rst AS (SELECT l.*, s.seq AS prio FROM lst l JOIN aq s ON s.event_id = l.event_id AND s.step = l.since WHERE l.remaining > 0)
SELECT instrument_id, id2 AS order_id, account_id, side, p2 AS price, remaining, row_number() OVER w AS queue_position, CAST(sum(remaining) OVER w AS BIGINT) - remaining AS qty_ahead
FROM rst WINDOW w AS (PARTITION BY instrument_id, side, p2 ORDER BY prio)"""


def rejected_events(spark, sf):
    """The events that books reject, by kind: they use up a sequence number and change nothing."""
    return book_sets.folded(amended(spark, sf)).filter("skipped").select("seq", "kind", "status", "order_id", "instrument_id", "qty")


def amended_replay(spark, sf):
    """The keyed state's trace: a second witness, without the count of orders."""
    return book.replay(amended(spark, sf), "trace")


QUERIES = {f.__name__: f for f in (amended_trace, amended_queue, rejected_events, amended_replay)}
ORACLE = {
    "amended_trace": BASE + TRACE,
    "amended_queue": BASE + QUEUE,
    "rejected_events": BASE + " SELECT seq, CASE is_exec WHEN 1 THEN 'execution' ELSE 'order' END AS kind, status, order_id, instrument_id, qty FROM aq WHERE skipped",
    "amended_replay": BASE + TRACE.replace(", r.level_orders", ""),
}
