"""FIX 4.2 text as columns and back: expressions only, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOH = "\x01"
DAY_NS = 86_400_000_000_000
#: Codes of sides and order types.
SIDE = {"1": "Buy", "2": "Sell"}
ORDER_TYPE = {"1": "Market", "2": "Limit"}


def field(raw: Column, tag: int) -> Column:
    """The first value of a tag; null if it isn't there (so the first entry of a repeating group is read)."""
    return value(ended(raw), tag)


def ended(raw: Column) -> Column:
    """A line up to its last delimiter, with one before it: every field stands between two."""
    return F.concat(F.lit(SOH), F.regexp_extract(raw, r"(?s)^(.*\x01)", 1))


def value(fields: Column, tag: int) -> Column:
    """The first value of a tag in an ended() line: one search and no pattern with alternatives, as lines are searched for some twenty tags."""
    return F.substring_index(F.get(F.split(fields, f"\x01{tag}=", 2), F.lit(1)), SOH, 1)


def utc_ns(text: Column) -> Column:
    """YYYYMMDD-HH:MM:SS and up to nine decimals as nanoseconds since 1970."""
    number = lambda a, n: F.try_to_number(F.substring(text, a, n), F.lit("9" * n)).cast("long")
    seconds = F.unix_date(F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")).cast("long") * 86_400 + number(10, 2) * 3_600 + number(13, 2) * 60 + number(16, 2)
    rest = F.rpad(F.substring(text, 19, 9), 9, "0")
    return F.when(text.rlike(r"^\d{8}-\d\d:\d\d:\d\d(\.\d{1,9})?$"), seconds * 1_000_000_000 + rest.cast("long"))


def utc_text(ns: Column, digits: int = 9) -> Column:
    """Nanoseconds since 1970 (also before) as YYYYMMDD-HH:MM:SS and decimals; cut, not rounded."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    within = F.pmod(ns, F.lit(DAY_NS))
    day = F.date_format(F.date_from_unix_date(div(ns - within, DAY_NS).cast("int")), "yyyyMMdd")
    clock = F.concat_ws(":", *(F.format_string("%02d", div(within, unit) % most) for unit, most in ((3_600_000_000_000, 24), (60_000_000_000, 60), (1_000_000_000, 60))))
    fraction = F.substring(F.format_string("%09d", F.pmod(ns, F.lit(1_000_000_000))), 1, digits)
    return F.concat(day, F.lit("-"), clock, F.lit("."), fraction)


def byte_sum(text: Column) -> Column:
    """The sum of a text's bytes: as Latin-1, every byte is a letter whose code is its value."""
    letters = F.split(F.decode(text.cast("binary"), "ISO-8859-1"), "")
    return F.aggregate(letters, F.lit(0), lambda a, c: a + F.ascii(c))


def problem(raw: Column) -> Column:
    """Why a line is no FIX 4.2 message; null if it is one."""
    body = F.regexp_extract(raw, r"(?s)^8=FIX\.4\.2\x019=\d+\x01(.*)10=\d{3}\x01$", 1)
    before = F.regexp_extract(raw, r"(?s)^(.*\x01)10=\d{3}\x01$", 1)
    return (
        F.when(raw.isNull() | (raw == ""), "empty")
        .when(~raw.startswith("8=FIX.4.2" + SOH), "not FIX 4.2")
        .when(~raw.rlike(r"(?s)^8=FIX\.4\.2\x019=\d+\x0135=[^\x01]+\x01.*\x0110=\d{3}\x01$"), "truncated")
        .when(F.octet_length(body) != F.regexp_extract(raw, r"\x019=(\d+)\x01", 1).cast("int"), "body length")
        .when(byte_sum(before) % 256 != F.regexp_extract(raw, r"\x0110=(\d{3})\x01$", 1).cast("int"), "checksum")
    )


def decode(lines: DataFrame, raw_col: str = "raw") -> DataFrame:
    """lines with error and the fields of EVENT rows (kind null for session messages).

    Orders (35=D), cancels (F) and executions (8) of both dialects: the venue in tag 100 or 30,
    the counterparty in the first 375, quantities rounded. A message that lacks a field that its
    type must have is an error, as is an unknown side.
    """
    raw = F.col(raw_col)
    lines = lines.withColumn("_fields", ended(raw))
    get = lambda tag: value(F.col("_fields"), tag)
    lines, kind = lines.withColumn("_kind", get(35)), F.col("_kind")
    mapped = lambda c, table: F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), c)
    qty = F.round(F.when(kind == "8", get(32)).otherwise(get(38)).try_cast("double")).cast("long")
    price = F.when(kind == "8", get(31)).otherwise(get(44)).try_cast("double")
    out = lines.withColumns({
        "msg_type": kind, "msg_seq_num": get(34).try_cast("long"),
        "kind": F.when(kind.isin("D", "F"), "order").when(kind == "8", "execution"),
        "status": F.when(kind == "D", "New").when(kind == "F", "Cancelled").otherwise(""),
        "order_id": F.when(kind == "8", get(37)).otherwise(get(11)), "orig_order_id": F.when(kind == "F", get(41)).otherwise(""), "trade_id": F.when(kind == "8", get(17)),
        "account_id": get(1), "instrument_id": get(55), "side": mapped(get(54), SIDE), "qty": qty, "price": F.when(kind == "F", F.lit(0.0)).otherwise(price),
        "order_type": F.when(kind == "F", "Limit").otherwise(mapped(get(40), ORDER_TYPE)), "timestamp_ns": utc_ns(get(60)),
        "venue": F.coalesce(F.when(kind == "8", get(30)), get(100), F.lit("")), "counterparty_account_id": F.when(kind == "8", F.coalesce(get(375), F.lit(""))),
    })
    needed = ["order_id", "account_id", "instrument_id", "qty", "price", "timestamp_ns"]
    missing = F.concat_ws(",", *(F.when(F.col(c).isNull(), c) for c in needed), F.when((kind == "8") & F.col("trade_id").isNull(), "trade_id"), F.when(kind.isin("D", "F") & F.col("side").isNull(), "side"), F.when((kind == "F") & F.col("orig_order_id").isNull(), "orig_order_id"))
    return out.withColumn("error", F.coalesce(problem(raw), F.when(F.col("kind").isNotNull() & (missing != ""), F.concat(F.lit("missing "), missing)))).drop("_fields", "_kind")


def encode(events: DataFrame, seq_col: str = "seq", sender: str = "SIM", target: str = "SURV", dialect: str = "text") -> DataFrame:
    """seq and raw: events (EVENT columns, and venue and order_type) as FIX text, replaces left out.

    Dialect "text": times in milliseconds, a fill's venue in ExDestination and its counterparty in a single ContraBroker. Dialect
    "object": times in nanoseconds, the venue in LastMkt and the counterparty in a group of one
    (NoContraBrokers), with ExecTransType and the client's order id. Prices have eight decimals in both.
    """
    if dialect not in ("text", "object"):
        raise ValueError(f"no such dialect: {dialect}")
    objects = dialect == "object"
    rows = events.filter("status != 'Replaced'")
    is_exec, new = F.col("kind") == "execution", F.col("status") == "New"
    tag = lambda t, v: F.concat(F.lit(f"{t}="), v.cast("string") if not isinstance(v, str) else F.lit(v), F.lit(SOH))
    price = F.format_string("%.8f", "price")
    side = F.when(F.col("side") == "Buy", "1").otherwise("2")
    time = utc_text(F.col("timestamp_ns"), 9 if objects else 3)
    common = F.concat(tag(1, F.col("account_id")), tag(55, F.col("instrument_id")))
    order = F.concat(tag(11, F.col("order_id")), common, tag(54, side), tag(38, F.col("qty")), tag(40, F.when(F.col("order_type") == "Market", "1").otherwise("2")), tag(44, price), tag(60, time), tag(100, F.coalesce("venue", F.lit(""))))
    cancel = F.concat(tag(11, F.col("order_id")), tag(41, F.col("orig_order_id")), common, tag(54, side), tag(38, F.col("qty")), tag(60, time))
    fill = F.concat(tag(37, F.col("order_id")), tag(17, F.col("trade_id")), common, tag(150, "F"), tag(39, "2"), tag(32, F.col("qty")), tag(31, price), tag(14, F.col("qty")), tag(151, "0"), tag(6, price), tag(375, F.coalesce("counterparty_account_id", F.lit(""))), tag(60, time), tag(100, F.coalesce("venue", F.lit(""))))
    if objects:
        fill = F.concat(
            tag(37, F.col("order_id")), tag(11, F.col("order_id")), tag(17, F.col("trade_id")), tag(20, "0"), common, tag(54, side), tag(150, "2"), tag(39, "2"), tag(32, F.col("qty")), tag(31, price), tag(30, F.coalesce("venue", F.lit(""))),
            tag(14, F.col("qty")), tag(151, "0"), tag(6, price), tag(60, time), tag(382, "1"), tag(375, F.coalesce("counterparty_account_id", F.lit(""))),
        )
    kind = F.when(is_exec, "8").when(new, "D").otherwise("F")
    body = F.concat(tag(35, kind), tag(49, sender), tag(56, target), tag(34, F.col(seq_col)), tag(52, time), F.when(is_exec, fill).when(new, order).otherwise(cancel))
    # In steps, as each is used twice by the next.
    bodies = rows.select(F.col(seq_col), body.alias("body"))
    wholes = bodies.select(seq_col, F.concat(F.lit(f"8=FIX.4.2{SOH}9="), F.octet_length("body").cast("string"), F.lit(SOH), "body").alias("whole"))
    return wholes.select(seq_col, F.concat("whole", F.lit("10="), F.format_string("%03d", byte_sum(F.col("whole")) % 256), F.lit(SOH)).alias("raw"))


def sequence_gaps(decoded: DataFrame, session_col: str) -> DataFrame:
    """Where a session's MsgSeqNum skips: the last number before the gap and the first after it."""
    from pyspark.sql.window import Window

    before = F.lag("msg_seq_num").over(Window.partitionBy(session_col).orderBy("msg_seq_num"))
    rows = decoded.filter("msg_seq_num is not null").select(session_col, F.col("msg_seq_num").alias("next"), before.alias("last"))
    return rows.filter("next > last + 1")
