"""The order flow written in each form that is read, with damaged lines among it, and read back; each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.storage import keep, shared_folder
from tapewatch.plans.surveillance import sequenced
from tapewatch.sources import adapter, files, fix

BASE = adapter.SQL
#: The flow's events with what only messages have; n chooses the lines to damage.
EVENTS = BASE + """, tl AS (SELECT evs.*, row_number() OVER (ORDER BY evs.timestamp_ns, evs.is_exec, evs.idx) AS seq, evs.kind = 'execution' AS done, x.trade_id, x.counterparty_account_id,
  CASE WHEN evs.event_id % 3 = 0 THEN 'Market' ELSE 'Limit' END AS order_type, 'V' || CAST(evs.event_id % 4 AS VARCHAR) AS venue FROM evs LEFT JOIN exe x ON evs.kind = 'execution' AND x.event_id = evs.event_id)"""
WHOLE = ("qty", "timestamp_ns")
#: Orders and executions of one JSON document, about 6 MB of text, and the fewest documents.
DOCUMENT_ROWS, MIN_DOCUMENTS = 20_000, 16
FIX_COLUMNS = ("kind", "status", "order_id", "orig_order_id", "trade_id", "account_id", "instrument_id", "side", "qty", "price", "order_type", "timestamp_ns", "venue", "counterparty_account_id")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return sequenced(spark, sf).withColumns({"order_type": F.when(e % 3 == 0, "Market").otherwise("Limit"), "venue": F.concat(F.lit("V"), (e % 4).cast("string"))})


def good(c: str) -> Column:
    """A field of a line without an error; else null, or 0 for a whole number."""
    return F.when(F.col("error").isNull(), F.col(c)).otherwise(0 if c in WHOLE else None).alias(c)


def decoded(lines: DataFrame) -> DataFrame:
    """Every line's error, or its fields if it has none."""
    return fix.decode(lines).select("seq", "error", *(good(c) for c in FIX_COLUMNS))


def fix_text(spark, sf):
    """The text dialect; of sixteen lines one each has another version, is cut, has a longer field, another letter, or nothing."""
    lines, n = fix.encode(messages(spark, sf)), F.col("seq") % 16
    other = lambda a, b: F.replace("raw", F.lit(a), F.lit(b))
    bad = (
        F.when(n == 1, other("8=FIX.4.2", "8=FIX.4.4")).when(n == 2, F.expr("left(raw, length(raw) - 4)")).when(n == 3, other("\x0155=INS", "\x0155=INSX"))
        .when(n == 4, other("\x0155=INS", "\x0155=INT")).when(n == 5, "").otherwise(F.col("raw"))
    )
    return decoded(lines.withColumn("raw", bad))


def fix_objects(spark, sf):
    """The object dialect, with nanoseconds, LastMkt and the group of contra brokers."""
    return decoded(fix.encode(messages(spark, sf), dialect="object"))


def fix_sql(time: str, side: str, errors: str = "NULL") -> str:
    fields = {
        "kind": "kind", "status": "status", "order_id": "order_id", "orig_order_id": "CASE WHEN status = 'Cancelled' THEN order_id ELSE '' END", "trade_id": "trade_id", "account_id": "account_id", "instrument_id": "instrument_id",
        "side": f"CASE WHEN done THEN {side} ELSE side END", "qty": "qty", "price": "CASE WHEN status = 'Cancelled' THEN 0.0::DOUBLE ELSE price END", "order_type": "CASE WHEN done THEN NULL WHEN status = 'Cancelled' THEN 'Limit' ELSE order_type END",
        "timestamp_ns": time, "venue": "CASE WHEN status = 'Cancelled' THEN '' ELSE venue END", "counterparty_account_id": "counterparty_account_id",
    }
    return EVENTS + " SELECT seq, error, " + ", ".join(f"CASE WHEN error IS NULL THEN {v} {'ELSE 0 ' if k in WHOLE else ''}END AS {k}" for k, v in fields.items()) + f" FROM (SELECT *, {errors} AS error FROM tl) t"


def event_json(spark, sf):
    """Events as JSON lines; of nine lines one each is cut, lacks its quantity, or is of another type."""
    lines = files.encode_events(messages(spark, sf))
    e = F.regexp_extract(F.get_json_object("value", "$.order_id"), r"(\d+)$", 1).cast("long") % 9
    value = F.when(e == 1, F.expr("left(value, length(value) - 1)")).when(e == 2, F.regexp_replace("value", r'"qty":\d+,', "")).when(e == 3, F.regexp_replace("value", '"type":"[a-z]+"', '"type":"other"')).otherwise(F.col("value"))
    rows = files.decode_events(lines.select(value.alias("value")))
    return rows.select("error", *(good(c) for c in ("kind", "order_id", "trade_id", "account_id", "counterparty_account_id", "instrument_id", "side", "price", "qty", "order_type", "timestamp_ns", "status", "venue", "orig_order_id")))


JSON = EVENTS + """ SELECT error, CASE WHEN ok THEN kind END AS kind, CASE WHEN ok AND NOT done THEN order_id WHEN ok THEN order_id END AS order_id, CASE WHEN ok THEN trade_id END AS trade_id, CASE WHEN ok THEN account_id END AS account_id,
  CASE WHEN ok THEN counterparty_account_id END AS counterparty_account_id, CASE WHEN ok THEN instrument_id END AS instrument_id, CASE WHEN ok THEN side END AS side, CASE WHEN ok THEN price END AS price, CASE WHEN ok THEN qty ELSE 0 END AS qty,
  CASE WHEN ok AND NOT done THEN order_type END AS order_type, CASE WHEN ok THEN timestamp_ns ELSE 0 END AS timestamp_ns, CASE WHEN ok AND NOT done THEN status END AS status, CASE WHEN ok THEN venue END AS venue,
  CASE WHEN ok AND NOT done THEN CASE WHEN status = 'Cancelled' THEN order_id ELSE '' END END AS orig_order_id
FROM (SELECT *, error IS NULL AS ok FROM (SELECT *, CASE event_id % 9 WHEN 1 THEN 'malformed' WHEN 2 THEN 'missing qty' WHEN 3 THEN 'unknown type' END AS error FROM tl) a) t"""


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders and executions with their labels."""
    rows = keep(adapter.labels(messages(spark, sf)).withColumn("gt_severity", (F.col("event_id") % 5) / 4.0))
    pick = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
    return rows.filter("kind = 'order'").select(*pick(files.ORDER_CSV)), rows.filter("kind = 'execution'").select(*pick(files.EXECUTION_CSV))


def both(orders: DataFrame, executions: DataFrame) -> DataFrame:
    return orders.unionByName(executions, allowMissingColumns=True)


def labelled_csv(spark, sf):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    orders, executions = labelled(spark, sf)
    files.write_labelled_csv(orders, f"{path}/orders")
    files.write_labelled_csv(executions, f"{path}/executions")
    return both(files.read_orders_csv(spark, f"{path}/orders"), files.read_executions_csv(spark, f"{path}/executions"))


def labelled_json(spark, sf):
    """Documents are as many as rows ask for: a reader takes one whole, so more rows must not make larger ones."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    orders, executions = labelled(spark, sf)
    documents = max(MIN_DOCUMENTS, -(-(orders.count() + executions.count()) // DOCUMENT_ROWS))
    files.labelled_documents(orders, executions, documents).write.partitionBy("part").text(path)
    return both(*files.read_labelled_json(spark, path))


LABELLED = EVENTS + """ SELECT order_id, account_id, instrument_id, CASE WHEN done THEN NULL ELSE side END AS side, price, qty, CASE WHEN done THEN NULL ELSE order_type END AS order_type, timestamp_ns, CASE WHEN done THEN NULL ELSE status END AS status,
  venue, trade_id, counterparty_account_id, CASE event_id % 20 WHEN 0 THEN 'WashTrade' WHEN 1 THEN 'SpoofingLayering' WHEN 2 THEN 'MarkingTheClose' WHEN 3 THEN 'FrontRunning' ELSE 'None' END AS gt_pattern,
  {empty} AS gt_scenario_id, CAST(event_id % 5 AS DOUBLE) / 4 AS gt_severity FROM tl"""
SCENARIO = "CASE WHEN event_id % 20 < 4 THEN 'SCN-' || CAST(event_id % 20 AS VARCHAR) || '-' || CAST(event_id // 200 AS VARCHAR) {otherwise} END"

QUERIES = {f.__name__: f for f in (fix_text, fix_objects, event_json, labelled_csv, labelled_json)}
ORACLE = {
    "fix_text": fix_sql("timestamp_ns // 1000000 * 1000000", "NULL", "CASE seq % 16 WHEN 1 THEN 'not FIX 4.2' WHEN 2 THEN 'truncated' WHEN 3 THEN 'body length' WHEN 4 THEN 'checksum' WHEN 5 THEN 'empty' END"),
    "fix_objects": fix_sql("timestamp_ns", "side"),
    "event_json": JSON,
    "labelled_csv": LABELLED.format(empty=SCENARIO.format(otherwise="")),
    "labelled_json": LABELLED.format(empty=SCENARIO.format(otherwise="ELSE ''")),
}
