"""Labelled synthetic order flow: a background session in Spark, and small abuse scenarios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND = 1_000_000_000
#: Symbols by asset class with tick size and daily volume.
INSTRUMENTS = (
    ("Equity", 0.01, 1_000_000, ("ACME", "GLBX", "NDEX", "ORCA", "PLTX", "QTRX", "RHNO", "STLR")),
    ("FX", 0.0001, 100_000_000, ("EURUSD", "USDJPY", "GBPUSD", "AUDUSD", "USDCHF")),
    ("FixedIncome", 0.01, 200_000, ("UST2Y", "UST5Y", "UST10Y", "UST30Y", "BUND10Y")),
)
#: Percentile tables of order sizes, price moves in ticks, and distances from the mid in ticks.
SIZES = ((0.00, 1), (0.10, 1), (0.25, 4), (0.50, 20), (0.75, 50), (0.90, 100), (0.99, 460), (1.00, 460))
MOVES = ((0.00, 0), (0.10, 0), (0.25, 0), (0.50, 0), (0.75, 1), (0.90, 4), (0.99, 28), (1.00, 28))
OFFSETS = ((0.00, 0), (0.10, 0), (0.25, 1), (0.50, 1), (0.75, 2), (0.90, 3), (0.99, 10), (1.00, 10))


@dataclass(frozen=True)
class Session:
    seed: int = 1
    start_ns: int = 1_700_000_000 * SECOND
    seconds: int = 600
    orders_per_second: float = 20.0
    n_equity: int = 2
    n_fx: int = 1
    n_fixed_income: int = 1
    independent: int = 20
    pairs: int = 5
    scenarios: int = 2
    severity: float = 0.9

    @property
    def close_ns(self) -> int:
        return self.start_ns + self.seconds * SECOND


def instruments(spark: SparkSession, s: Session) -> DataFrame:
    rows = [(sym, sym, kind, tick, volume, s.close_ns) for (kind, tick, volume, syms), n in zip(INSTRUMENTS, (s.n_equity, s.n_fx, s.n_fixed_income)) for sym in syms[:n]]
    return spark.createDataFrame(rows, "instrument_id string, symbol string, asset_class string, tick_size double, avg_daily_volume bigint, session_close_ns bigint")


def accounts(spark: SparkSession, s: Session) -> DataFrame:
    """Independent accounts, and pairs that share an owner and list each other."""
    n, single = F.col("id"), F.col("id") < s.independent
    name = lambda p, c: F.concat(F.lit(p), F.format_string("%06d", c))
    pair = F.floor((n - s.independent) / 2)
    first = (n - s.independent) % 2 == 0
    owner = F.when(single, n + 1).otherwise(pair + s.independent + 1)
    other = F.when(first, n + 2).otherwise(n)
    return spark.range(s.independent + 2 * s.pairs).select(
        name("ACC-", n + 1).alias("account_id"), name("OWN-", owner).alias("owner_id"), F.when(single | first, "Client").otherwise("Proprietary").alias("entity_type"),
        F.when(single, F.array().cast("array<string>")).otherwise(F.array(name("ACC-", other))).alias("linked_account_ids"),
    )


def from_table(u: Column, table) -> Column:
    """The value at quantile u of a percentile table, linear between its points."""
    out = F.lit(float(table[-1][1]))
    for (p, a), (q, b) in reversed(list(zip(table, table[1:]))):
        out = F.when(u <= q, a + (u - p) / (q - p) * (b - a)).otherwise(out)
    return out


def reference_price(instrument: Column, kind: Column) -> Column:
    """A price for the asset class, moved by a hash of the instrument."""
    jitter = F.pmod(F.xxhash64(instrument), F.lit(1000)) / 1000.0
    return F.when(kind == "Equity", 50 + 150 * jitter).when(kind == "FX", 0.8 + 0.7 * jitter).otherwise(95 + 10 * jitter)


def to_tick(price: Column, tick: Column) -> Column:
    return F.when(tick <= 0, price).otherwise(F.round(price / tick) * tick)


def background(spark: SparkSession, s: Session) -> tuple[DataFrame, DataFrame]:
    """Unlabelled orders and executions: exponential gaps, a walking price, 60 % filled, 15 % partly, 15 % cancelled, 10 % left open.

    Every random number is a hash of seed, instrument, row and purpose, so that a task that runs
    again gives the same rows. Times and prices are running sums over an instrument.
    """
    u = lambda what: F.pmod(F.xxhash64(F.lit(s.seed), F.lit(what), "instrument_id", "i"), F.lit(1 << 52)) / float(1 << 52)
    names = instruments(spark, s)
    per = max(1, int(s.seconds * s.orders_per_second / max(1, s.n_equity + s.n_fx + s.n_fixed_income)))
    rows = spark.range(per).withColumnRenamed("id", "i").join(F.broadcast(names))  # one row an instrument
    so_far = Window.partitionBy("instrument_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    gap = -F.log(1 - u("gap")) * (s.seconds / per)
    step = F.when(u("direction") < 0.5, -1).otherwise(1) * F.floor(from_table(u("move"), MOVES))
    rows = rows.withColumns({"timestamp_ns": F.lit(s.start_ns) + (F.sum(gap).over(so_far) * SECOND).cast("long"), "_walk": F.sum(step).over(so_far), "side": F.when(u("side") < 0.5, "Buy").otherwise("Sell")})
    offset = F.floor(from_table(u("offset"), OFFSETS)) * F.when(F.col("side") == "Buy", -1).otherwise(1)
    price = F.greatest(to_tick(reference_price(F.col("instrument_id"), F.col("asset_class")) + (F.col("_walk") + offset) * F.col("tick_size"), F.col("tick_size")), F.col("tick_size"))
    n_accounts = s.independent + 2 * s.pairs
    account = lambda w: F.format_string("ACC-%06d", F.floor(u(w) * n_accounts) + 1)
    fate = u("fate")
    rows = rows.filter(F.col("timestamp_ns") < s.close_ns).select(
        F.concat(F.lit("ORD-"), "instrument_id", F.lit("-"), F.format_string("%09d", "i")).alias("order_id"), account("account").alias("account_id"), "instrument_id", "side", price.alias("price"),
        F.greatest(F.lit(1).cast("long"), F.floor(from_table(u("size"), SIZES)).cast("long")).alias("qty"), F.when(u("type") < 0.1, "Market").otherwise("Limit").alias("order_type"), "timestamp_ns",
        F.when(fate < 0.60, "fill").when(fate < 0.75, "partial").when(fate < 0.90, "cancel").otherwise("open").alias("fate"), u("delay").alias("delay"), account("other").alias("counterparty_account_id"),
    )
    label = {"gt_pattern": F.lit("None"), "gt_scenario_id": F.lit(""), "gt_severity": F.lit(0.0)}
    base = rows.withColumn("venue", F.lit("SIM"))
    cols = ("order_id", "account_id", "instrument_id", "side", "price", "qty", "order_type", "timestamp_ns", "status", "venue")
    new = base.withColumn("status", F.lit("New")).select(*cols)
    gone = base.filter("fate = 'cancel'").withColumns({"status": F.lit("Cancelled"), "timestamp_ns": F.col("timestamp_ns") + ((0.5 + 29.5 * F.col("delay")) * SECOND).cast("long")}).select(*cols)
    done = base.filter("fate in ('fill', 'partial')").select(
        F.concat(F.lit("EXE-"), F.substring("order_id", 5, 100)).alias("trade_id"), "order_id", "account_id", "instrument_id", "price", F.when(F.col("fate") == "fill", F.col("qty")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(F.col("qty") / 2).cast("long"))).alias("qty"),
        (F.col("timestamp_ns") + ((0.01 + 1.99 * F.col("delay")) * SECOND).cast("long")).alias("timestamp_ns"), "counterparty_account_id", "venue",
    )
    return new.unionByName(gone).withColumns(label), done.withColumns(label)


class _Scenario:
    """Collects the rows of one scenario."""

    def __init__(self, pattern: str, number: int, s: Session, rng: np.random.Generator, instrument: tuple, pair: tuple[str, str], others: list[str]) -> None:
        self.pattern, self.id, self.s, self.rng = pattern, f"{pattern}-{number:06d}", s, rng
        self.instrument, self.tick, self.mid = instrument
        self.client, self.related = pair
        self.others = others
        self.orders, self.executions = [], []

    def order(self, account: str, side: str, price: float, qty: int, ts: int, labelled: bool = True, status: str = "New", order_id: str | None = None) -> str:
        oid = order_id or f"ORD-{self.id}-{len(self.orders) + 1:04d}"
        label = (self.pattern, self.id, self.s.severity) if labelled else ("None", "", 0.0)
        self.orders.append((oid, account, self.instrument, side, round(price, 6), int(qty), "Limit", int(ts), status, "SIM", *label))
        return oid

    def fill(self, order_id: str, account: str, other: str, price: float, qty: int, ts: int, labelled: bool = True) -> None:
        label = (self.pattern, self.id, self.s.severity) if labelled else ("None", "", 0.0)
        self.executions.append((f"EXE-{self.id}-{len(self.executions) + 1:04d}", order_id, account, self.instrument, round(price, 6), int(qty), int(ts), other, "SIM", *label))

    def mix(self, mild: float, severe: float) -> float:
        return mild + (severe - mild) * self.s.severity


def _wash(x: _Scenario, at: int) -> None:
    """Two related accounts trade with each other; the milder, the more their sizes and times differ."""
    qty = int(x.rng.integers(100, 501))
    twin = max(1, round(qty * (1 + x.rng.uniform(-1, 1) * x.mix(0.3, 0.02))))
    later = at + int(x.rng.uniform(0, x.mix(5, 0.2)) * SECOND)
    a = x.order(x.client, "Buy", x.mid, qty, at)
    b = x.order(x.related, "Sell", x.mid, twin, later)
    done = later + SECOND // 100
    x.fill(a, x.client, x.related, x.mid, min(qty, twin), done)
    x.fill(b, x.related, x.client, x.mid, min(qty, twin), done)


def _spoof(x: _Scenario, at: int) -> None:
    """Large layers far from the mid, the other side gives way, a small genuine order fills, and the layers go."""
    layers, price = int(x.rng.integers(3, 7)), x.mid - 8 * x.tick
    far, near = x.others[0], x.others[1]
    near_ask = x.order(near, "Sell", x.mid + x.tick, 100, at - 2 * SECOND, False)
    x.order(far, "Sell", x.mid + 3 * x.tick, 100, at - 2 * SECOND, False)
    sizes = x.rng.integers(800, 1600, layers)
    ids = [(x.order(x.client, "Buy", price - k * x.tick, sizes[k], at + k * SECOND // 20), price - k * x.tick) for k in range(layers)]
    own = x.order(x.client, "Sell", x.mid + 2 * x.tick, 50, at + SECOND // 2)
    x.order(near, "Sell", x.mid + x.tick, 100, at + 6 * SECOND // 10, False, "Cancelled", near_ask)
    x.fill(own, x.client, far, x.mid + 2 * x.tick, 50, at + 7 * SECOND // 10)
    dwell = int(x.mix(1.8, 0.2) * 5 * SECOND)
    for k, (oid, p) in enumerate(ids):
        x.order(x.client, "Buy", p, sizes[k], at + dwell + k * SECOND // 100, True, "Cancelled", oid)


def _close(x: _Scenario, at: int) -> None:
    """Linked accounts trade a large share of the last minutes' volume."""
    n = int(x.rng.integers(3, 11))
    ambient = x.s.orders_per_second * 300 * 30 / max(1, x.s.n_equity + x.s.n_fx + x.s.n_fixed_income)
    share = x.mix(0.15, 0.65)
    qty = max(60, int(ambient * share / (1 - share) / n))
    last = x.s.close_ns - SECOND
    for k in range(n):
        ts = last - int((n - k) * min(20, x.s.seconds / 20) * SECOND)
        who = (x.client, x.related)[k % 2]
        oid = x.order(who, "Buy", x.mid + k * x.tick, qty, ts)
        x.fill(oid, who, x.others[k % len(x.others)], x.mid + k * x.tick, qty, ts + SECOND // 100)


def _front(x: _Scenario, at: int) -> None:
    """A client's large order, and a related account's small one right after it."""
    large, small = int(x.rng.integers(1000, 4001)), int(x.rng.integers(100, 501))
    small = min(small, large // 5)
    a = x.order(x.client, "Buy", x.mid, large, at)
    t = at + int(x.rng.uniform(0.02, 0.15) * SECOND)
    b = x.order(x.related, "Buy", x.mid + x.tick, small, t)
    x.fill(b, x.related, x.others[0], x.mid + x.tick, small, t + SECOND // 20)
    x.fill(a, x.client, x.others[1], x.mid + 2 * x.tick, large, t + SECOND)
    if x.s.severity >= 0.5:
        c = x.order(x.related, "Sell", x.mid + 4 * x.tick, small, t + 2 * SECOND)
        x.fill(c, x.related, x.others[0], x.mid + 4 * x.tick, small, t + 2 * SECOND + SECOND // 20)


SCENARIOS = {"WashTrade": _wash, "SpoofingLayering": _spoof, "MarkingTheClose": _close, "FrontRunning": _front}


def abuse(spark: SparkSession, s: Session) -> tuple[DataFrame, DataFrame]:
    """Labelled orders and executions of s.scenarios scenarios of each pattern: a few rows each, drawn from their own stream of numbers."""
    from tapewatch.sources.files import EXECUTION_CSV, ORDER_CSV

    rng = np.random.default_rng([s.seed, 0x9E3779B9])
    names = [(sym, tick) for (_, tick, _, syms), n in zip(INSTRUMENTS, (s.n_equity, s.n_fx, s.n_fixed_income)) for sym in syms[:n]]
    account = lambda i: f"ACC-{i + 1:06d}"
    orders, executions = [], []
    for pattern, make in SCENARIOS.items():
        for k in range(s.scenarios if s.pairs and s.independent >= 2 else 0):
            sym, tick = names[int(rng.integers(len(names)))]
            p = s.independent + 2 * int(rng.integers(s.pairs))
            x = _Scenario(pattern, k + 1, s, rng, (sym, tick, 100.0), (account(p), account(p + 1)), [account(int(i)) for i in rng.permutation(s.independent)[:5]])
            last = max(s.start_ns + 3 * SECOND, s.close_ns - 300 * SECOND)
            make(x, int(rng.uniform(s.start_ns + 3 * SECOND, last + 1)))
            orders += x.orders
            executions += x.executions
    return spark.createDataFrame(orders, ORDER_CSV), spark.createDataFrame(executions, EXECUTION_CSV)


def session(spark: SparkSession, s: Session) -> tuple[DataFrame, DataFrame]:
    """All orders and executions of a session, with their labels."""
    (a, b), (c, d) = background(spark, s), abuse(spark, s)
    return a.unionByName(c), b.unionByName(d)


def to_events(orders: DataFrame, executions: DataFrame) -> DataFrame:
    """EVENT rows without labels: times first, orders before executions, then ids; a cancel names the order that it ends.

    An execution gets its order's side; one without an order is left out.
    """
    none = F.lit(None).cast("string")
    order = orders.select(F.lit("order").alias("kind"), "order_id", F.when(F.col("status") == "Cancelled", F.col("order_id")).otherwise("").alias("orig_order_id"), none.alias("trade_id"), "account_id", none.alias("counterparty_account_id"), "instrument_id", "side", "price", "qty", F.when(F.col("status") == "Cancelled", "Cancelled").otherwise("New").alias("status"), "timestamp_ns", F.lit(0).alias("is_exec"), F.concat("order_id", F.when(F.col("status") == "Cancelled", "~").otherwise("")).alias("idx"), F.col("order_type"), "venue")
    sides = orders.filter("status = 'New'").groupBy("order_id").agg(F.first("side").alias("side"))
    done = executions.join(sides, "order_id").select(F.lit("execution").alias("kind"), "order_id", F.lit("").alias("orig_order_id"), "trade_id", "account_id", "counterparty_account_id", "instrument_id", "side", "price", "qty", F.lit("").alias("status"), "timestamp_ns", F.lit(1).alias("is_exec"), F.col("trade_id").alias("idx"), F.lit("Limit").alias("order_type"), "venue")
    return order.unionByName(done)


def enforcement_case(spark: SparkSession, start_ns: int = 1_700_000_000 * SECOND) -> DataFrame:
    """A known layering case as events with seq: five cycles of five large sells that nobody hit, 61 events in all."""
    rows = []
    base, tick, n = 1150.0, 0.25, 0

    def add(status: str, oid: str, who: str, side: str, price: float, qty: int, ts: int) -> None:
        rows.append((len(rows) + 1, "order", oid, oid if status == "Cancelled" else "", None, who, None, "ES", side, price, qty, status, ts))

    def fresh() -> str:
        nonlocal n
        n += 1
        return f"CASE-ORD-{n}"

    bid_price, bid = base, fresh()
    todo = [("New", bid, "LIQUIDITY", "Buy", bid_price, 50, start_ns)]
    for cycle in range(5):
        at = start_ns + cycle * 60 * SECOND
        layers = [(fresh(), base + tick * (4 + k), (188, 289)[k % 2], at + k * SECOND // 2) for k in range(5)]
        todo += [("New", oid, "LAYERER", "Sell", p, q, t) for oid, p, q, t in layers]
        todo.append(("Cancelled", bid, "LIQUIDITY", "Buy", bid_price, 50, at + 4 * SECOND))
        bid_price, bid = bid_price - tick, fresh()
        todo.append(("New", bid, "LIQUIDITY", "Buy", bid_price, 50, at + 4 * SECOND + 1_000_000))
        todo += [("Cancelled", oid, "LAYERER", "Sell", p, q, t + 8 * SECOND) for oid, p, q, t in layers]
    for one in sorted(todo, key=lambda r: r[-1]):
        add(*one)
    from tapewatch.functions.schemas import EVENT

    return spark.createDataFrame(rows, EVENT)
