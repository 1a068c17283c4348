"""Order books as joins and grouped rows: replaces, rejects, and the best prices after every event, without a keyed state.

Whether an event is accepted, and what it takes from and adds to the book, depends only on the orders it names. So
orders that replace one another make families, each family's few events are folded on their own (streams of Arrow batches), and all else are
sums and spans over the numbered events of an instrument, which any number of tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.running import best_covers, few_sent, join_keys, last_before, running_sums, with_position
from tapewatch.functions.scalars import clamp01, fixed6
from tapewatch.functions.schemas import require_unlabelled
from tapewatch.functions.storage import keep
from tapewatch.operators.components import component_labels
from tapewatch.operators.keyed import ARROW

#: Codes of what an event does; any other order status is OTHER.
EXECUTION, NEW, CANCEL, REPLACE, OTHER = range(5)
TAKEN = ("taken_side string", "taken_price double", "taken_qty bigint", "added_side string", "added_price double", "added_qty bigint")
RESTING = "instrument_id string, id string, side string, price double, account string, qty bigint, prio bigint"
#: The order of an event that takes or adds none.
NOTHING = (None,) * 5
#: Rounds in which chains of up to 2 ** (ROUNDS - 1) replaces find their first order; longer ones, circles and orders that replace several are labelled as components.
ROUNDS = 6


def node(id_: Column) -> Column:
    return F.concat(F.col("instrument_id"), F.lit("\0"), id_)


def target(e) -> Column:
    """The id of the resting order that an event names."""
    return F.when(e["status"].isin("Cancelled", "Replaced"), e["orig_order_id"]).otherwise(e["order_id"])


def first_orders(links: DataFrame) -> DataFrame | None:
    """node, label: the first order of each replacing order's chain, by pointers that double their reach; None if links (a, replaced by b) aren't chains that end within ROUNDS."""
    ahead = keep(links.filter("a != b").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"), F.max("a").alias("last")))
    if ahead.filter("up != last").limit(1).count():
        return None
    ahead, found = ahead.select("node", "up"), []
    for _ in range(ROUNDS):
        # Who points at an order that replaced none has found the first; the others take over what they point at.
        ahead = keep(ahead.join((ahead if not found else ahead.unionByName(found[-1])).select(F.col("node").alias("up"), F.col("up").alias("_up")), "up", "left"))
        found.append(ahead.filter("_up is null").select("node", "up") if not found else found[-1].unionByName(ahead.filter("_up is null").select("node", "up")))
        ahead = ahead.filter("_up is not null").select("node", F.col("_up").alias("up"))
        if not ahead.limit(1).count():
            return found[-1].withColumnRenamed("up", "label")
    return None


def family_of(events: DataFrame) -> DataFrame:
    """events with family: one order's id for all orders that replace one another, or the named order's own."""
    links = events.filter("status = 'Replaced'").select(node(F.col("orig_order_id")).alias("a"), node(F.col("order_id")).alias("b"))
    named = events.withColumn("family", node(target(events)))
    if not links.limit(1).count():
        return named
    labels = first_orders(links)
    labels = (component_labels(links) if labels is None else labels).withColumnRenamed("node", "family")
    return named.join(labels, "family", "left").withColumn("family", F.coalesce("label", "family")).drop("label")


class Family:
    """The resting orders of one family: id to side, price, account, quantity and prio, the number of the event at which it took its place.

    A replace at another price or of more quantity goes to the back (prio is its own number); any other keeps its order's place. A
    replace that goes to the back takes its order out even if its new id is resting already and it is rejected.
    Beside the book stand the orders as detectors see them, who hear of accepted events alone: id to the event that
    placed it under its id and what is left of it.
    """

    def __init__(self) -> None:
        self.book: dict[str, tuple] = {}
        self.watch: dict[str, tuple[int, int]] = {}

    def apply(self, seq: int, what: int, at: str, own: str, side: str, price: float, account: str, qty: int) -> tuple:
        """Whether the event (which names at, and whose own id is own) is rejected, the orders that it takes from the book and adds to it, and the placing event of the order that it ends."""
        book, watch = self.book, self.watch
        held = book.get(at)
        taken = added = ended = None
        clash = own in book and (what == NEW or own != at)
        skipped = clash if what in (NEW, REPLACE) else False
        if what == EXECUTION:
            skipped = held is None or qty > held[3]
            if not skipped:
                taken = held
                added = (*held[:3], held[3] - qty, held[4]) if qty < held[3] else None
        elif what == CANCEL:
            taken = held
        elif what == NEW:
            added = None if clash else (side, price, account, qty, seq)
        elif what == REPLACE:
            skipped = clash or held is None
            if held is not None:
                back = price != held[1] or qty > held[3]
                taken = held if back or not clash else None
                if not clash:
                    added = (side, price, account, qty, seq) if back else (*held[:3], qty, held[4])
        if taken is not None:
            del book[at]
        if added is not None:
            book[at if what == EXECUTION else own] = added
        if not skipped:
            if what != NEW and at in watch and (what != EXECUTION or watch[at][1] <= qty):
                ended = watch.pop(at)[0]
            if what in (NEW, REPLACE):
                watch[own] = (seq, qty)
            elif what == EXECUTION and own in watch:
                watch[own] = (watch[own][0], watch[own][1] - qty)
        return skipped, taken, added, ended


def changes_key(column: pa.Array) -> np.ndarray:
    """Places from the second on whose value isn't that before; null equals null."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(pc.is_null(here), pc.is_null(before)))
    return ~same.to_numpy(zero_copy_only=False)


def values(column: pa.Array) -> list:
    """to_pylist() by way of numpy, which takes a tenth of its time; numbers with nulls would become floats there."""
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def folded(events: DataFrame, resting: bool = False) -> DataFrame:
    """events with skipped, what each took from and added to the book (TAKEN, null if nothing) and ended; or, if resting, the orders at the end (RESTING). Written once.

    events: EVENT columns with seq. Families are dealt over the tasks and sorted; a task reads its part as a stream of batches and holds the orders of one family that rest.
    """
    columns = [c for c in events.columns if c not in ("trade_id", "counterparty_account_id")]
    status = F.col("status")
    what = F.when(F.col("kind") == "execution", EXECUTION).when(status == "New", NEW).when(status == "Cancelled", CANCEL).when(status == "Replaced", REPLACE).otherwise(OTHER)
    used = ("seq", "_what", "_at", "order_id", "side", "price", "account_id", "_qty")
    rows = family_of(require_unlabelled(events).select(*columns)).withColumns({"_what": what, "_at": target(events), "_qty": F.coalesce("qty", F.lit(0).cast("long"))})
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*columns).schema)
    schema = RESTING if resting else ", ".join((own, "skipped boolean", *TAKEN, "ended bigint"))
    kinds = [ARROW[f.split()[1]] for f in (RESTING.split(", ") if resting else ("skipped boolean", *TAKEN, "ended bigint"))]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, family = None, Family()
        for b in batches:
            if not b.num_rows:
                continue
            ends = (b.column("instrument_id"), b.column("family"))
            anew = np.concatenate([[at != tuple(c[0].as_py() for c in ends)], changes_key(ends[0]) | changes_key(ends[1])])
            out, lists = [], [values(b.column(c)) for c in used]
            for starts, instrument, *e in zip(anew.tolist(), values(ends[0]) if resting else anew, *lists):
                if starts:
                    if resting and at is not None:
                        out += ((at[0], i, *o) for i, o in family.book.items())
                    at, family = (instrument, None), Family()
                skipped, taken, added, ended = family.apply(*e)
                if not resting:
                    took, adds = taken or NOTHING, added or NOTHING
                    out.append((skipped, took[0], took[1], took[3], adds[0], adds[1], adds[3], ended))
            at = tuple(c[-1].as_py() for c in ends)
            made = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays(made if resting else [*(b.column(c) for c in columns), *made], names=names)
        if resting and at is not None:
            out = [(at[0], i, *o) for i, o in family.book.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    return keep(rows.repartition("instrument_id", "family").sortWithinPartitions("instrument_id", "family", "seq").mapInArrow(run, schema))


def level_changes(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each event and level that it names or changes: dq and dn are what its quantity and its orders gain. carry names more columns to keep."""
    own = lambda x: F.coalesce((F.col(f"{x}_side") == F.col("side")) & F.col(f"{x}_price").eqNullSafe(F.col("price")), F.lit(False))
    both = F.coalesce((F.col("taken_side") == F.col("added_side")) & F.col("taken_price").eqNullSafe(F.col("added_price")), F.lit(False))
    gain = lambda t, a, of: F.when(a, of("added")).otherwise(0) - F.when(t, of("taken")).otherwise(0)
    qty, one = lambda x: F.coalesce(F.col(f"{x}_qty"), F.lit(0)), lambda x: F.lit(1)
    entry = lambda side, price, t, a, named: F.struct(side.alias("side"), price.alias("price"), gain(t, a, qty).cast("long").alias("dq"), gain(t, a, one).cast("long").alias("dn"), F.lit(named).alias("named"))
    yes, no, taken, added = F.lit(True), F.lit(False), F.col("taken_qty").isNotNull(), F.col("added_qty").isNotNull()
    entries = F.array(
        entry(F.col("side"), F.col("price"), own("taken"), own("added"), True),
        F.when(taken & ~own("taken"), entry(F.col("taken_side"), F.col("taken_price"), yes, added & both, False)),
        F.when(added & ~own("added") & ~(taken & both), entry(F.col("added_side"), F.col("added_price"), no, yes, False)),
    )
    more = ("instrument_id", "sequence", "seq", "skipped", "timestamp_ns", *carry)
    return events.select(*more, F.explode(F.array_compact(entries)).alias("l")).select(*more, "l.*")


def level_spans(states: DataFrame, top: int) -> DataFrame:
    """key, side, lo, hi, worth: when each level held orders. states: level changes with their running level_orders.

    The n-th opening of a level belongs to the n-th closing; both have the number of openings so far.
    """
    turns = states.filter("(level_orders > 0) != (level_orders - dn > 0)").select("instrument_id", "side", "price", "sequence", (F.col("dn") > 0).cast("long").alias("opens"))
    counted = running_sums(turns, ["instrument_id", "side", "price"], "sequence", {"nth": "opens"})
    spans = counted.groupBy("instrument_id", "side", "price", "nth").agg(F.min("sequence").alias("lo"), F.max(F.when(F.col("opens") == 0, F.col("sequence"))).alias("hi"))
    worth = F.when(F.col("side") == "Buy", F.col("price")).otherwise(-F.col("price"))
    return keep(spans.select(F.col("instrument_id").alias("key"), "side", "lo", F.coalesce("hi", F.lit(top + 1)).alias("hi"), worth.alias("worth")))


def trace(events: DataFrame) -> DataFrame:
    """A row for each event (with a unique seq) after it was applied: sequence (its number in the instrument), skipped, best_bid, best_ask,
    and level_qty and level_orders of the level that it names. The same rows as book.replay(events, "trace") gives.

    Each family is folded by itself; level totals are running sums over blocks of events, and best prices are looked up among the spans in which
    levels held orders. So one instrument's events are shared by all tasks.
    """
    return traced(events).drop("side", "price")


def traced(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """trace with side and price, and with the columns in carry; events may bring their sequence with them."""
    used = events.select("instrument_id", "seq", "kind", "status", "order_id", "orig_order_id", "side", "price", "qty", "account_id", "timestamp_ns", *(c for c in ("sequence",) if c in events.columns))
    changes = level_changes(folded(used if "sequence" in used.columns else with_position(used, ["instrument_id"], ["seq"], "sequence")), carry)
    states = keep(running_sums(changes, ["instrument_id", "side", "price"], "sequence", {"level_qty": "dq", "level_orders": "dn"}))
    top = states.agg(F.max("sequence")).first()[0] or 0
    points = states.filter("named").withColumnsRenamed({"instrument_id": "key", "sequence": "at"}).drop("dq", "dn", "named")
    best = best_covers(points, level_spans(states, top), top).withColumnsRenamed({"key": "instrument_id", "at": "sequence", "bid": "best_bid"})
    return best.withColumn("best_ask", -F.col("ask")).drop("ask")


def spoof_scores(events: DataFrame, threshold: float = 0.6, slow_ns: int = 5_000_000_000, window_ns: int = 30_000_000_000) -> DataFrame:
    """A row for each accepted cancel of a resting order, scored by its share of its level, its haste, what the other side's best price did, and how many orders
    of its side the account has beside those that others usually have. The rows of book.replay(events, "scores") where time never goes back in an instrument.

    Counts of the last window_ns are differences of two running sums: at the cancel, and at a mark that stands window_ns earlier among the events. The mean over
    other accounts is the difference of all and own. No task has more than blocks of an instrument's rows.
    """
    rows = keep(traced(events, ("kind", "status", "orig_order_id", "account_id", "qty", "ended")).filter("not skipped"))
    placing = rows.filter("kind = 'order' and status in ('New', 'Replaced')")
    depth = F.when(F.col("level_qty") != 0, F.col("qty") / F.col("level_qty")).otherwise(0.0)
    born = placing.select(F.col("seq").alias("since"), F.col("account_id").alias("t_account"), F.col("side").alias("t_side"), F.col("timestamp_ns").alias("placed"), depth.alias("depth"), F.when(F.col("side") == "Buy", F.col("best_ask")).otherwise(F.col("best_bid")).alias("best_then"))
    gone = keep(rows.filter("ended is not null").join(born, F.col("ended") == F.col("since")))
    # How many orders an account has on a side after each event that changes it.
    steps = placing.select("instrument_id", "account_id", "side", "sequence", F.lit(1).alias("step")).unionByName(gone.select("instrument_id", F.col("t_account").alias("account_id"), F.col("t_side").alias("side"), "sequence", F.lit(-1).alias("step")))
    steps = keep(steps.groupBy("instrument_id", "account_id", "side", "sequence").agg(F.sum("step").alias("step")))
    live = keep(running_sums(steps, ["instrument_id", "account_id", "side"], "sequence", {"live": "step"}).drop("step"))
    samples = placing.select("instrument_id", "account_id", "side", "sequence", "timestamp_ns").join(live, ["instrument_id", "account_id", "side", "sequence"])
    cancels = gone.filter("kind = 'order' and status = 'Cancelled' and timestamp_ns >= placed").select("instrument_id", "sequence", "seq", "timestamp_ns", "orig_order_id", "best_bid", "best_ask", "t_account", "t_side", "placed", "depth", "best_then")
    cancels = keep(cancels.join(live.withColumnsRenamed({"account_id": "t_account", "side": "t_side", "live": "concurrent"}), ["instrument_id", "t_account", "t_side", "sequence"]))
    known = last_before(rows.select("instrument_id", "sequence", "timestamp_ns", "best_bid", "best_ask"), ["instrument_id"], "sequence", {"bid_before": "best_bid", "ask_before": "best_ask"})
    moved = lambda side: F.coalesce(F.col(f"best_{side}") != F.col(f"{side}_before"), F.lit(False)).cast("long")
    # Every event that counts, each cancel, and its mark: at equal times marks come first, as what is window_ns old still counts.
    none = F.lit(0).cast("long")
    what = ("bids", "asks", "buy", "buys", "sell", "sells")
    zero = {c: none for c in what}
    row = lambda df, account, mark, ts, **values: df.select("instrument_id", ts.alias("timestamp_ns"), "sequence", F.lit(mark).alias("mark"), account.alias("account"), *(v.cast("long").alias(c) for c, v in (zero | values).items()))
    ts, own = F.col("timestamp_ns"), lambda side, v: F.when(F.col("side") == side, v).otherwise(0)
    line = row(known.withColumns({"b": moved("bid"), "a": moved("ask")}).filter("a + b > 0"), F.lit(None).cast("string"), 1, ts, bids=F.col("b"), asks=F.col("a"))
    line = line.unionByName(row(samples, F.col("account_id"), 2, ts, buy=own("Buy", F.col("live")), buys=own("Buy", 1), sell=own("Sell", F.col("live")), sells=own("Sell", 1)))
    line = line.unionByName(row(cancels, F.col("t_account"), 3, ts)).unionByName(row(cancels, F.col("t_account"), 0, ts - window_ns))
    line = with_position(line, ["instrument_id"], ["timestamp_ns", F.when(F.col("mark") == 0, -1).otherwise(F.col("sequence")), "mark", "sequence"], "place")
    line = keep(running_sums(line, ["instrument_id"], "place", {f"all_{c}": c for c in what}))
    line = running_sums(line, ["instrument_id", "account"], "place", {f"own_{c}": c for c in what[2:]})
    sums = [*(f"all_{c}" for c in what), *(f"own_{c}" for c in what[2:])]
    line = keep(line.filter("mark in (0, 3)"))
    lately = line.groupBy("instrument_id", "sequence").agg(*(F.sum(F.when(F.col("mark") == 3, F.col(c)).otherwise(-F.col(c))).alias(c) for c in sums))
    buy = F.col("t_side") == "Buy"
    pick = lambda c: F.when(buy, F.col(c.format("buy"))).otherwise(F.col(c.format("sell")))
    others, n = pick("all_{}") - pick("own_{}"), pick("all_{}s") - pick("own_{}s")
    dt, clamp = ts - F.col("placed"), clamp01
    speed = clamp(1 - dt / slow_ns)
    gap = F.when(buy, F.col("best_ask") - F.col("best_then")).otherwise(F.col("best_then") - F.col("best_bid"))
    reacted = F.coalesce(gap >= 0.01, F.lit(False))
    moves = F.when(buy, F.col("all_asks")).otherwise(F.col("all_bids"))
    move = F.when(reacted, clamp(1 - moves / (window_ns / 1e9) * F.least(dt, F.lit(slow_ns)) / 1e9)).otherwise(0.0)
    found = cancels.join(lately, ["instrument_id", "sequence"]).withColumns({"dt": dt, "speed": speed, "reacted": reacted, "move": move, "typical": F.when(n > 0, others / n).otherwise(0.0)})
    found = found.withColumn("layering", clamp((F.col("concurrent") - F.col("typical")) / 3))
    found = found.withColumn("score", clamp((F.col("depth") + F.col("speed") + F.col("move")) / 3 + 0.15 * F.col("layering")))
    six = lambda name, c: F.concat(F.lit(f"{name}="), fixed6(F.col(c)))
    said = F.concat_ws(
        " ", six("depth_ratio", "depth"), six("speed", "speed"), F.concat(F.lit("opposite_price_moved_favorably="), F.col("reacted").cast("string")), six("move_score", "move"), F.concat(F.lit("concurrent_same_side_orders="), F.col("concurrent").cast("string")),
        six("typical_concurrent", "typical"), six("layering_score", "layering"), F.concat(F.lit("time_in_book_ns="), F.col("dt").cast("string")),
    )
    return found.select("instrument_id", "seq", F.col("sequence").alias("book_snapshot_sequence"), "score", (F.col("score") >= threshold).alias("fired"), F.col("t_account").alias("account_id"), F.col("orig_order_id").alias("order_id"), F.col("placed").alias("window_start_ns"), ts.alias("window_end_ns"), said.alias("evidence"))


def resting_orders(events: DataFrame) -> DataFrame:
    """The orders at the end: instrument_id, order_id, account_id, side, price, remaining, and prio, the seq at which each took its place."""
    return folded(events, resting=True).withColumnsRenamed({"id": "order_id", "account": "account_id", "qty": "remaining"})


def queue(events: DataFrame) -> DataFrame:
    """resting_orders with queue_position and qty_ahead in their level: the place that a replace kept or lost."""
    rows = with_position(resting_orders(events), ["instrument_id", "side", "price"], ["prio"], "queue_position")
    rows = running_sums(keep(rows), ["instrument_id", "side", "price"], "queue_position", {"upto": "remaining"})
    return rows.withColumn("qty_ahead", F.col("upto") - F.col("remaining")).drop("upto", "prio")


def snapshots(events: DataFrame) -> DataFrame:
    """The books at the end, a row for each resting order: the instrument's sequence and last_event_timestamp_ns (rejected events count), side, price, its level's
    total_qty, place (from 0) and the order with its account and what is left of it. The orders that book.replay(events, "snapshots") gives.

    No task holds a book or a level: places are gapless numbers of one range sort, and a level's total is a sum.
    """
    level = ["instrument_id", "side", "price"]
    orders = with_position(resting_orders(events), level, ["prio"], "place")
    totals = few_sent(orders.groupBy(*level).agg(F.sum("remaining").alias("total_qty")))
    ends = few_sent(events.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("sequence"), F.max_by("timestamp_ns", "seq").alias("last_event_timestamp_ns")))
    rows = join_keys(join_keys(orders, totals, level), ends, ["instrument_id"]).withColumn("place", F.col("place") - 1)
    return rows.select("instrument_id", "sequence", "last_event_timestamp_ns", "side", "price", "total_qty", "place", "order_id", "account_id", F.col("remaining").alias("qty"))
