"""Order books: set-based for clean flow, and an exact keyed state for replaces, rejects and spoofing."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.functions.schemas import require_unlabelled

IN = ("instrument_id", "seq", "kind", "status", "order_id", "orig_order_id", "account_id", "side", "price", "qty", "timestamp_ns")


class Level(dict):
    """The ids of a level's orders by place, in rising order: a new id takes its order's place in one step, however long the queue. Iterates over the ids."""

    def __iter__(self) -> Iterator[str]:
        return iter(self.values())


class Book:
    """Price-time priority book of one instrument."""

    def __init__(self) -> None:
        self.orders: dict[str, list] = {}  # id: [side, price, account, qty, place]
        self.levels: dict[str, dict[float, Level]] = {"Buy": {}, "Sell": {}}
        self.totals: dict[tuple[str, float], int] = {}
        self.heaps: dict[str, list[float]] = {"Buy": [], "Sell": []}
        self.sequence, self.last_ns = 0, 0

    def best(self, side: str) -> float | None:
        heap, sign = self.heaps[side], -1 if side == "Buy" else 1
        while heap and sign * heap[0] not in self.levels[side]:
            heappop(heap)
        return sign * heap[0] if heap else None

    def level_qty(self, side: str, price: float) -> int:
        return self.totals.get((side, price), 0)

    def _insert(self, oid: str, side: str, price: float, account: str, qty: int) -> None:
        if oid in self.orders:
            raise ValueError(f"order {oid} is resting already")
        level = self.levels[side].get(price)
        if level is None:
            level = self.levels[side][price] = Level()
            heappush(self.heaps[side], -price if side == "Buy" else price)
        level[self.sequence] = oid
        self.orders[oid] = [side, price, account, qty, self.sequence]
        self.totals[side, price] = self.totals.get((side, price), 0) + qty

    def _change(self, oid: str, by: int) -> None:
        side, price, _, qty, place = self.orders[oid]
        self.orders[oid][3] = qty + by
        self.totals[side, price] += by
        if qty + by <= 0:
            del self.orders[oid], self.levels[side][price][place]
            if not self.levels[side][price]:
                del self.levels[side][price], self.totals[side, price]

    def apply(self, e: dict) -> None:
        """Apply an event; ValueError if it contradicts the book. Its sequence number is used up either way."""
        self.sequence += 1
        self.last_ns = e["timestamp_ns"]
        if e["kind"] == "execution":
            held = self.orders.get(e["order_id"])
            if held is None or e["qty"] > held[3]:
                raise ValueError("execution of an unknown order or beyond its quantity")
            self._change(e["order_id"], -e["qty"])
        elif e["status"] == "New":
            self._insert(e["order_id"], e["side"], e["price"], e["account_id"], e["qty"])
        elif e["status"] == "Cancelled":
            if e["orig_order_id"] in self.orders:
                self._change(e["orig_order_id"], -self.orders[e["orig_order_id"]][3])
        else:
            held = self.orders.get(e["orig_order_id"])
            if held is None:
                raise ValueError("replace of an unknown order")
            if e["price"] != held[1] or e["qty"] > held[3]:
                self._change(e["orig_order_id"], -held[3])
                self._insert(e["order_id"], e["side"], e["price"], e["account_id"], e["qty"])
            else:
                if e["order_id"] != e["orig_order_id"] and e["order_id"] in self.orders:
                    raise ValueError("the new id is resting already")
                side, price, account, qty, place = held
                self.totals[side, price] += e["qty"] - qty
                del self.orders[e["orig_order_id"]]
                self.orders[e["order_id"]] = [side, price, account, e["qty"], place]
                self.levels[side][price][place] = e["order_id"]

    def snapshot(self, instrument: str) -> dict:
        def side(name: str) -> list[dict]:
            return [
                {"price": p, "total_qty": self.totals[name, p], "orders": [{"order_id": o, "account_id": self.orders[o][2], "qty": self.orders[o][3]} for o in self.levels[name][p]]}
                for p in sorted(self.levels[name], reverse=name == "Buy")
            ]

        return {"instrument_id": instrument, "sequence": self.sequence, "last_event_timestamp_ns": self.last_ns, "bids": side("Buy"), "asks": side("Sell")}


def clamp(x: float) -> float:
    return min(max(x, 0.0), 1.0)


class SpoofState:
    """Detector of large, short-lived orders that the other side reacted to. Called after the book."""

    SLOW, WINDOW = 5_000_000_000, 30_000_000_000

    def __init__(self, threshold: float = 0.6) -> None:
        self.threshold = threshold
        self.tracked: dict[str, dict] = {}
        self.live: dict[tuple[str, str], int] = {}
        self.last_best: dict[str, float | None] = {"Buy": None, "Sell": None}
        self.moves: dict[str, deque] = {"Buy": deque(), "Sell": deque()}
        self.samples: dict[str, deque] = {"Buy": deque(), "Sell": deque()}
        self.sums: dict[str, dict] = {"Buy": {}, "Sell": {}}  # account: [sum, n]; None: all accounts
        self.newest, self.ordered = None, True

    def _sample(self, side: str, account: str, value: int, sign: int) -> None:
        for key in (account, None):
            got = self.sums[side].setdefault(key, [0, 0])
            got[0] += sign * value
            got[1] += sign
            if not got[1]:
                del self.sums[side][key]

    def _prune(self, ts: int) -> None:
        self.ordered = self.ordered and (self.newest is None or ts >= self.newest)
        self.newest = ts
        far = lambda t: abs(ts - t) > self.WINDOW
        for side in ("Buy", "Sell"):
            moves, samples = self.moves[side], self.samples[side]
            if self.ordered:
                while moves and far(moves[0]):
                    moves.popleft()
                while samples and far(samples[0][0]):
                    self._sample(side, *samples.popleft()[1:], -1)
                continue
            self.moves[side] = deque(t for t in moves if not far(t))
            for t, account, n in samples:
                if far(t):
                    self._sample(side, account, n, -1)
            self.samples[side] = deque(s for s in samples if not far(s[0]))

    def _erase(self, oid: str) -> dict | None:
        t = self.tracked.pop(oid, None)
        if t is not None:
            self.live[t["account"], t["side"]] -= 1
        return t

    def _new(self, book: Book, e: dict) -> None:
        side, ts = e["side"], e["timestamp_ns"]
        level = book.level_qty(side, e["price"])
        key = (e["account_id"], side)
        self.live[key] = self.live.get(key, 0) + 1
        self.tracked[e["order_id"]] = {"account": e["account_id"], "side": side, "placed": ts, "depth": e["qty"] / level if level else 0.0, "best": book.best("Sell" if side == "Buy" else "Buy"), "left": e["qty"]}
        self.samples[side].append((ts, e["account_id"], self.live[key]))
        self._sample(side, e["account_id"], self.live[key], 1)

    def process(self, book: Book, e: dict) -> dict | None:
        ts = e["timestamp_ns"]
        best = {s: book.best(s) for s in ("Buy", "Sell")}
        for side in ("Buy", "Sell"):
            if self.last_best[side] is not None and best[side] is not None and best[side] != self.last_best[side]:
                self.moves[side].append(ts)
            if best[side] is not None:
                self.last_best[side] = best[side]
        self._prune(ts)
        if e["kind"] == "execution":
            t = self.tracked.get(e["order_id"])
            if t is not None:
                t["left"] -= e["qty"]
                if t["left"] <= 0:
                    self._erase(e["order_id"])
            return None
        if e["status"] == "New":
            self._new(book, e)
            return None
        if e["status"] == "Replaced":
            self._erase(e["orig_order_id"])
            self._new(book, e)
            return None
        t = self._erase(e["orig_order_id"])
        if t is None or ts < t["placed"]:
            return None
        side, other = t["side"], "Sell" if t["side"] == "Buy" else "Buy"
        dt = ts - t["placed"]
        speed = clamp(1 - dt / self.SLOW)
        moved = t["best"] is not None and best[other] is not None and (best[other] - t["best"] >= 0.01 if side == "Buy" else best[other] - t["best"] <= -0.01)
        move = clamp(1 - len(self.moves[other]) / (self.WINDOW / 1e9) * min(dt, self.SLOW) / 1e9) if moved else 0.0
        (every, n), (own, k) = self.sums[side].get(None, (0, 0)), self.sums[side].get(t["account"], (0, 0))
        typical = (every - own) / (n - k) if n > k else 0.0
        concurrent = self.live[t["account"], side]
        layering = clamp((concurrent - typical) / 3)
        score = clamp((t["depth"] + speed + move) / 3 + 0.15 * layering)
        said = f"depth_ratio={t['depth']:.6f} speed={speed:.6f} opposite_price_moved_favorably={'true' if moved else 'false'} move_score={move:.6f} concurrent_same_side_orders={concurrent} typical_concurrent={typical:.6f} layering_score={layering:.6f} time_in_book_ns={dt}"
        return {"score": score, "fired": score >= self.threshold, "account_id": t["account"], "order_id": e["orig_order_id"], "window_start_ns": t["placed"], "window_end_ns": ts, "evidence": said}


TRACE = "instrument_id string, seq bigint, sequence bigint, skipped boolean, best_bid double, best_ask double, level_qty bigint, timestamp_ns bigint"
SCORES = "instrument_id string, seq bigint, book_snapshot_sequence bigint, score double, fired boolean, account_id string, order_id string, window_start_ns bigint, window_end_ns bigint, evidence string"
SNAPSHOTS = "instrument_id string, snapshot string"


def replay(events: DataFrame, emit: str, threshold: float = 0.6) -> DataFrame:
    """Run the book and the spoofing state over events (with a column seq), each instrument in seq order.

    emit: "trace" (a row for each event, after it was applied), "scores" (a row for each cancel
    that was scored) or "snapshots" (the book at the end, as JSON). Partitions hold whole
    instruments sorted by seq and are read as streams of batches: a task holds the state of one
    instrument, never its events. Events that contradict the book reach no detector.
    """
    require_unlabelled(events)
    schema = {"trace": TRACE, "scores": SCORES, "snapshots": SNAPSHOTS}[emit]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = pa.schema([(name, arrow[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        at, book, spoof, rows = None, None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows.clear()

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for values in zip(*columns):
                e = dict(zip(IN, values))
                if e["instrument_id"] != at:
                    if emit == "snapshots" and book is not None:
                        rows.append({"instrument_id": at, "snapshot": json.dumps(book.snapshot(at))})
                    at, book, spoof = e["instrument_id"], Book(), SpoofState(threshold)
                skipped = False
                try:
                    book.apply(e)
                except ValueError:
                    skipped = True
                if emit == "trace":
                    rows.append({"instrument_id": at, "seq": e["seq"], "sequence": book.sequence, "skipped": skipped, "best_bid": book.best("Buy"), "best_ask": book.best("Sell"), "level_qty": book.level_qty(e["side"], e["price"]), "timestamp_ns": e["timestamp_ns"]})
                elif emit == "scores" and not skipped:
                    got = spoof.process(book, e)
                    if got:
                        rows.append({"instrument_id": at, "seq": e["seq"], "book_snapshot_sequence": book.sequence, **got})
            yield from flush()
        if emit == "snapshots" and book is not None:
            rows.append({"instrument_id": at, "snapshot": json.dumps(book.snapshot(at))})
        yield from flush()

    dealt = events.select(*IN).repartition("instrument_id").sortWithinPartitions("instrument_id", "seq")
    return dealt.mapInArrow(run, schema)


def remaining_orders(new_orders: DataFrame, executions: DataFrame, cancels: DataFrame) -> DataFrame:
    """new_orders with remaining > 0 at the end of the flow: for flow without replaces and rejects."""
    filled = executions.groupBy("order_id").agg(F.sum("qty").alias("filled"))
    gone = cancels.select("order_id", F.lit(True).alias("gone"))
    rows = new_orders.join(filled, "order_id", "left").join(gone, "order_id", "left")
    left = F.when(F.col("gone"), F.lit(0).cast("long")).otherwise(F.col("qty") - F.coalesce("filled", F.lit(0).cast("long")))
    return rows.withColumn("remaining", left).filter("remaining > 0").drop("filled", "gone")


def book_levels(live: DataFrame) -> DataFrame:
    return live.groupBy("instrument_id", "side", "price").agg(F.sum("remaining").alias("total_qty"), F.count(F.lit(1)).alias("n_orders"))


def best_prices(levels: DataFrame) -> DataFrame:
    """Best bid and ask of each instrument, null if a side is empty, and their spread."""
    best = levels.groupBy("instrument_id").agg(F.max(F.when(F.col("side") == "Buy", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "Sell", F.col("price"))).alias("best_ask"))
    return best.withColumns({"spread": F.col("best_ask") - F.col("best_bid"), "midpoint": (F.col("best_ask") + F.col("best_bid")) / 2})


def cumulative_depth(levels: DataFrame, top: int | None = None) -> DataFrame:
    """Levels with their rank from the best, the depth up to them, and their share of the largest level."""
    outward = F.when(F.col("side") == "Buy", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("instrument_id", "side").orderBy(outward)
    out = levels.withColumns({"level": F.row_number().over(w), "cumulative_qty": F.sum("total_qty").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.withColumn("width", F.round(F.col("total_qty") / F.max("total_qty").over(Window.partitionBy("instrument_id")), 6))
    return out if top is None else out.filter(F.col("level") <= top)


def queue_positions(live: DataFrame) -> DataFrame:
    w = Window.partitionBy("instrument_id", "side", "price").orderBy("timestamp_ns", "idx")
    return live.withColumns({"queue_position": F.row_number().over(w), "qty_ahead": F.coalesce(F.sum("remaining").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))})
