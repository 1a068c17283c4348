"""Order flow derived from the test tables' events, by integer arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.storage import ship_package

START_NS, CLOSE_NS = 1_704_067_200_000_000_000, 1_704_068_200_000_000_000
#: Patterns that label one event in twenty each.
LABELS = {0: "WashTrade", 1: "SpoofingLayering", 2: "MarkingTheClose", 3: "FrontRunning"}


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ts as microseconds since 1970, whatever the session's time zone."""
    ship_package(spark)
    ts = F.col("ts")
    micros = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", micros.alias("ts_us"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new order for every event."""
    e = F.col("event_id")
    account = lambda u: F.concat(F.lit("ACC-"), F.lpad(u.cast("string"), 6, "0"))
    return event_rows(spark, sf_dir).select(
        "event_id", "user_id", "event_type",
        F.concat(F.lit("ORD-"), F.lpad(e.cast("string"), 8, "0")).alias("order_id"),
        account(F.col("user_id")).alias("account_id"),
        F.concat(F.lit("OWN-"), F.expr("user_id div 2").cast("string")).alias("owner_id"),
        F.concat(F.lit("INS-"), ((e * 7 + F.col("user_id")) % 5).cast("string")).alias("instrument_id"),
        F.when(F.expr("(event_id div 3) % 2") == 0, "Buy").otherwise("Sell").alias("side"),
        (F.lit(100.0) + ((e * 13) % 21 - 10) * 0.25).alias("price"),
        F.greatest(F.lit(1).cast("long"), F.floor(F.col("value") * 10).cast("long")).alias("qty"),
        (F.lit(START_NS) + F.expr(f"((ts_us - {START_NS // 1000}) * 1000) div 2592")).alias("timestamp_ns"),
        (((e * 7919) % 1990 + 10) * 1_000_000).alias("delay_ns"),
    )


def fill_qty() -> F.Column:
    return F.when(F.col("event_type") == "signup", F.greatest(F.lit(1).cast("long"), F.expr("qty div 2"))).when(F.col("event_type").isin("click", "purchase"), F.col("qty")).otherwise(F.lit(0).cast("long"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full fills of clicks and purchases, partial fills of signups."""
    rows = orders(spark, sf_dir)
    users = event_rows(spark, sf_dir).agg((F.max("user_id") + 1).alias("n_users"))  # one row
    filled = rows.filter(F.col("event_type").isin("click", "purchase", "signup")).join(F.broadcast(users))
    return filled.select(
        "event_id", F.concat(F.lit("EXE-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("trade_id"),
        "order_id", "account_id", "instrument_id", "side", "price", fill_qty().alias("qty"),
        (F.col("timestamp_ns") + F.col("delay_ns")).alias("timestamp_ns"),
        F.concat(F.lit("ACC-"), F.lpad(((F.col("user_id") * 31 + F.col("event_id")) % F.col("n_users")).cast("string"), 6, "0")).alias("counterparty_account_id"),
    )


def cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).filter("event_type = 'error'").withColumn("timestamp_ns", F.col("timestamp_ns") + F.col("delay_ns"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as EVENT rows without seq: kind, is_exec and idx give their total order with timestamp_ns."""
    new = orders(spark, sf_dir).select("event_id", F.lit("order").alias("kind"), "order_id", F.lit("").alias("orig_order_id"), F.lit(None).cast("string").alias("trade_id"), "account_id", F.lit(None).cast("string").alias("counterparty_account_id"), "instrument_id", "side", "price", "qty", F.lit("New").alias("status"), "timestamp_ns", F.lit(0).alias("is_exec"), (F.col("event_id") * 2).alias("idx"))
    gone = cancels(spark, sf_dir).select("event_id", F.lit("order").alias("kind"), "order_id", F.col("order_id").alias("orig_order_id"), F.lit(None).cast("string").alias("trade_id"), "account_id", F.lit(None).cast("string").alias("counterparty_account_id"), "instrument_id", "side", "price", "qty", F.lit("Cancelled").alias("status"), "timestamp_ns", F.lit(0).alias("is_exec"), (F.col("event_id") * 2 + 1).alias("idx"))
    done = executions(spark, sf_dir).select("event_id", F.lit("execution").alias("kind"), "order_id", F.lit("").alias("orig_order_id"), "trade_id", "account_id", "counterparty_account_id", "instrument_id", "side", "price", "qty", F.lit("").alias("status"), "timestamp_ns", F.lit(1).alias("is_exec"), (F.col("event_id") * 2).alias("idx"))
    return new.unionByName(gone).unionByName(done)


def amended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second flow from the same orders, with replaces and with events that books reject; EVENT rows without seq.

    By event_id modulo 8 an order is replaced once (fewer at the same price, which keeps its place; another
    price, or more, which loses it) or twice in a row; its fill or cancel names its last id. By event_id modulo 11 there
    comes before that a fill of more than it has, a replace of an order that isn't there, its own id again (all
    three are rejected), or a cancel of an order that isn't there (which changes nothing).
    """
    none = F.lit(None).cast("string")
    name = lambda prefix: F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    rows = orders(spark, sf_dir).withColumns({"k": F.col("event_id") % 8, "j": F.col("event_id") % 11})
    half = lambda c: F.greatest(F.lit(1).cast("long"), F.expr(f"{c} div 2"))
    rows = rows.withColumns({"p1": F.col("price") + F.when(F.col("k").isin(2, 5), 0.25).otherwise(0.0), "q1": F.when(F.col("k").isin(1, 4), half("qty")).when(F.col("k") == 3, F.col("qty") + 5).otherwise(F.col("qty"))})
    rows = rows.withColumns({"p2": F.col("p1") + F.when(F.col("k") == 4, 0.5).otherwise(0.0), "q2": F.when(F.col("k") == 5, half("q1")).otherwise(F.col("q1"))})
    once, twice = F.col("k").between(1, 5), F.col("k").isin(4, 5)
    rows = rows.withColumns({"id1": F.when(once, name("RPA")).otherwise(F.col("order_id")), "id2": F.when(twice, name("RPB")).when(once, name("RPA")).otherwise(F.col("order_id"))})

    def event(step: int, part: int | None, kind: str, status: str, id_, orig, price, qty, trade=none) -> F.Column:
        at = F.col("timestamp_ns") + (F.lit(0) if part is None else F.expr(f"delay_ns div {part}"))
        return F.struct(
            F.lit(kind).alias("kind"), id_.alias("order_id"), orig.alias("orig_order_id"), trade.alias("trade_id"), price.alias("price"), qty.alias("qty"), F.lit(status).alias("status"),
            at.alias("at"), F.lit(int(kind == "execution")).alias("is_exec"), (F.col("event_id") * 8 + step).alias("idx"),
        )

    col, blank = F.col, F.lit("")
    filled = F.when(col("event_type") == "signup", half("q2")).otherwise(col("q2"))
    steps = F.array_compact(F.array(
        event(0, None, "order", "New", col("order_id"), blank, col("price"), col("qty")),
        F.when(col("j") == 5, event(1, 8, "execution", "", col("order_id"), blank, col("price"), col("qty") + 1, name("OVR"))),
        F.when(col("j") == 6, event(1, 8, "order", "Replaced", name("RPG"), name("GHO"), col("price"), col("qty"))),
        F.when(col("j") == 7, event(1, 8, "order", "New", col("order_id"), blank, col("price"), col("qty"))),
        F.when(col("j") == 8, event(1, 8, "order", "Cancelled", name("GHO"), name("GHO"), col("price"), col("qty"))),
        F.when(once, event(2, 4, "order", "Replaced", name("RPA"), col("order_id"), col("p1"), col("q1"))),
        F.when(twice, event(3, 2, "order", "Replaced", name("RPB"), name("RPA"), col("p2"), col("q2"))),
        F.when(col("event_type").isin("click", "purchase", "signup"), event(4, 1, "execution", "", col("id2"), blank, col("p2"), filled, name("EXE"))),
        F.when(col("event_type") == "error", event(4, 1, "order", "Cancelled", col("id2"), col("id2"), col("p2"), col("q2"))),
    ))
    out = rows.select("event_id", "account_id", none.alias("counterparty_account_id"), "instrument_id", "side", F.explode(steps).alias("e")).select("event_id", "account_id", "counterparty_account_id", "instrument_id", "side", "e.*")
    return out.withColumnRenamed("at", "timestamp_ns")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account with its owner; adjacent users share one, and no further links are listed."""
    users = event_rows(spark, sf_dir).agg((F.max("user_id") + 1).alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("u"))
    return users.select(F.concat(F.lit("ACC-"), F.lpad(F.col("u").cast("string"), 6, "0")).alias("account_id"), F.concat(F.lit("OWN-"), F.expr("u div 2").cast("string")).alias("owner_id"), F.lit("Client").alias("entity_type"), F.array().cast("array<string>").alias("linked_account_ids"))


def labels(df: DataFrame) -> DataFrame:
    """df with gt_pattern and gt_scenario_id."""
    kind = F.col("event_id") % 20
    pattern = F.lit("None")
    for k, v in LABELS.items():
        pattern = F.when(kind == k, v).otherwise(pattern)
    return df.withColumns({"gt_pattern": pattern, "gt_scenario_id": F.when(kind < len(LABELS), F.concat(F.lit("SCN-"), kind.cast("string"), F.lit("-"), F.expr("event_id div 200").cast("string"))).otherwise("")})


SQL = """WITH ord AS (
  SELECT event_id, user_id, event_type, 'ORD-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS order_id,
    'ACC-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS account_id, 'OWN-' || CAST(user_id // 2 AS VARCHAR) AS owner_id,
    'INS-' || CAST((event_id * 7 + user_id) % 5 AS VARCHAR) AS instrument_id,
    CASE WHEN (event_id // 3) % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side,
    100.0 + CAST((event_id * 13) % 21 - 10 AS DOUBLE) * 0.25 AS price,
    greatest(1, CAST(floor(value * 10) AS BIGINT)) AS qty,
    1704067200000000000 + ((epoch_us(ts) - 1704067200000000) * 1000) // 2592 AS timestamp_ns,
    ((event_id * 7919) % 1990 + 10) * 1000000 AS delay_ns
  FROM events),
exe AS (
  SELECT event_id, 'EXE-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS trade_id, order_id, account_id, owner_id, instrument_id, side, price,
    CASE WHEN event_type = 'signup' THEN greatest(1, qty // 2) ELSE qty END AS qty, timestamp_ns + delay_ns AS timestamp_ns,
    (user_id * 31 + event_id) % (SELECT max(user_id) + 1 FROM events) AS cp_user,
    'ACC-' || lpad(CAST((user_id * 31 + event_id) % (SELECT max(user_id) + 1 FROM events) AS VARCHAR), 6, '0') AS counterparty_account_id
  FROM ord WHERE event_type IN ('click', 'purchase', 'signup')),
can AS (SELECT event_id, order_id, account_id, owner_id, instrument_id, side, price, qty, timestamp_ns + delay_ns AS timestamp_ns FROM ord WHERE event_type = 'error'),
ent AS (SELECT u AS user_id, 'ACC-' || lpad(CAST(u AS VARCHAR), 6, '0') AS account_id, 'OWN-' || CAST(u // 2 AS VARCHAR) AS owner_id FROM (SELECT unnest(range((SELECT max(user_id) + 1 FROM events))) AS u)),
evs AS (
  SELECT event_id, 'order' AS kind, order_id, account_id, instrument_id, side, price, qty, 'New' AS status, timestamp_ns, 0 AS is_exec, event_id * 2 AS idx FROM ord
  UNION ALL SELECT event_id, 'order', order_id, account_id, instrument_id, side, price, qty, 'Cancelled', timestamp_ns, 0, event_id * 2 + 1 FROM can
  UNION ALL SELECT event_id, 'execution', order_id, account_id, instrument_id, side, price, qty, '', timestamp_ns, 1, event_id * 2 FROM exe)
"""
#: The second flow with what each event takes from its level (tq at tp) and adds (aq at ap), known from how it was made. Follows SQL.
AMENDED_SQL = SQL + """, am AS (SELECT *, p1 + CASE WHEN k = 4 THEN 0.5::DOUBLE ELSE 0 END AS p2, CASE WHEN k = 5 THEN greatest(1, q1 // 2) ELSE q1 END AS q2,
    CASE WHEN k IN (4, 5) THEN 'RPB-' || n8 WHEN k BETWEEN 1 AND 5 THEN 'RPA-' || n8 ELSE order_id END AS id2 FROM (
  SELECT *, event_id % 8 AS k, event_id % 11 AS j, lpad(CAST(event_id AS VARCHAR), 8, '0') AS n8, price + CASE WHEN event_id % 8 IN (2, 5) THEN 0.25::DOUBLE ELSE 0 END AS p1,
    CASE WHEN event_id % 8 IN (1, 4) THEN greatest(1, qty // 2) WHEN event_id % 8 = 3 THEN qty + 5 ELSE qty END AS q1 FROM ord) o),
fin AS (SELECT *, CASE WHEN event_type = 'signup' THEN greatest(1, q2 // 2) ELSE q2 END AS fq FROM am WHERE event_type <> 'view'),
ae AS (
  SELECT event_id, 0 AS step, 0 AS is_exec, timestamp_ns, 'New' AS status, order_id, instrument_id, account_id, side, price, qty, false AS skipped, NULL::DOUBLE AS tp, NULL::BIGINT AS tq, price AS ap, qty AS aq FROM am
  UNION ALL SELECT event_id, 1, 1, timestamp_ns + delay_ns // 8, '', order_id, instrument_id, account_id, side, price, qty + 1, true, NULL, NULL, NULL, NULL FROM am WHERE j = 5
  UNION ALL SELECT event_id, 1, 0, timestamp_ns + delay_ns // 8, 'Replaced', 'RPG-' || n8, instrument_id, account_id, side, price, qty, true, NULL, NULL, NULL, NULL FROM am WHERE j = 6
  UNION ALL SELECT event_id, 1, 0, timestamp_ns + delay_ns // 8, 'New', order_id, instrument_id, account_id, side, price, qty, true, NULL, NULL, NULL, NULL FROM am WHERE j = 7
  UNION ALL SELECT event_id, 1, 0, timestamp_ns + delay_ns // 8, 'Cancelled', 'GHO-' || n8, instrument_id, account_id, side, price, qty, false, NULL, NULL, NULL, NULL FROM am WHERE j = 8
  UNION ALL SELECT event_id, 2, 0, timestamp_ns + delay_ns // 4, 'Replaced', 'RPA-' || n8, instrument_id, account_id, side, p1, q1, false, price, qty, p1, q1 FROM am WHERE k BETWEEN 1 AND 5
  UNION ALL SELECT event_id, 3, 0, timestamp_ns + delay_ns // 2, 'Replaced', 'RPB-' || n8, instrument_id, account_id, side, p2, q2, false, p1, q1, p2, q2 FROM am WHERE k IN (4, 5)
  UNION ALL SELECT event_id, 4, 1, timestamp_ns + delay_ns, '', id2, instrument_id, account_id, side, p2, fq, false, p2, q2, CASE WHEN fq < q2 THEN p2 END, CASE WHEN fq < q2 THEN q2 - fq END FROM fin WHERE event_type <> 'error'
  UNION ALL SELECT event_id, 4, 0, timestamp_ns + delay_ns, 'Cancelled', id2, instrument_id, account_id, side, p2, q2, false, p2, q2, NULL, NULL FROM fin WHERE event_type = 'error'),
aq AS (SELECT *, row_number() OVER (ORDER BY timestamp_ns, is_exec, event_id, step) AS seq, row_number() OVER (PARTITION BY instrument_id ORDER BY timestamp_ns, is_exec, event_id, step) AS sequence FROM ae)
"""
