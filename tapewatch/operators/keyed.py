"""Detectors as keyed states that see each event once, in processing order, also when time goes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.schemas import require_unlabelled
from tapewatch.operators.relations import relation_keys

ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
PAIRS = "instrument_id string, side string, seq bigint, prior_order string, order_id string, prior_account string, account_id string, window_start_ns bigint, window_end_ns bigint"
OUTLIERS = "account_id string, instrument_id string, seq bigint, order_id string, z double, score double, mean double, sd double, n bigint, timestamp_ns bigint"


class FrontRunState:
    """Large orders of one instrument and side that every later order has left within the window.

    An order that lies further than the window from a kept one drops it for good, in either
    direction of time; so does the reference behaviour that this reproduces.
    """

    def __init__(self, window_ns: int = 2_000_000_000, large_qty: int = 1000, ratio: float = 0.2) -> None:
        self.window, self.large, self.ratio = window_ns, large_qty, ratio
        self.kept: list[tuple] = []

    def add(self, order_id: str, account: str, keys: list[str] | None, qty: int, ts: int) -> list[tuple]:
        """(prior order, prior account, prior time) of each kept order that this one front-runs."""
        self.kept = [k for k in self.kept if abs(ts - k[0]) <= self.window]
        mine = set(keys or ())
        hits = [(o, a, t) for t, o, a, q, rel in self.kept if a != account and qty <= self.ratio * q and ts >= t and mine & rel]
        if qty >= self.large:
            self.kept.append((ts, order_id, account, qty, frozenset(mine)))
        return hits


class RunningStats:
    """Welford's mean and deviation of an account's quantities in an instrument; a value is judged by those before it."""

    def __init__(self, threshold: float = 3.0, min_samples: int = 5) -> None:
        self.threshold, self.least = threshold, min_samples
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def add(self, x: float) -> dict | None:
        out = None
        sd = sqrt(self.m2 / (self.n - 1)) if self.n > 1 else 0.0
        if self.n >= self.least and sd > 0:
            z = (x - self.mean) / sd
            if abs(z) >= self.threshold:
                out = {"z": z, "score": min(abs(z) / (2 * self.threshold), 1.0), "mean": self.mean, "sd": sd, "n": self.n}
        self.n += 1
        step = x - self.mean
        self.mean += step / self.n
        self.m2 += step * (x - self.mean)
        return out


def over_keys(rows: DataFrame, keys: list[str], fresh: Callable, step: Callable[[object, dict], list[dict]], schema: str) -> DataFrame:
    """step(state, row) over rows (with seq), each key's rows in seq order and with a state of its own.

    Partitions hold whole keys sorted by seq and are read as streams, so that a task holds one state.
    """
    names = rows.columns
    kinds = pa.schema([(n, ARROW[k]) for n, k in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, fresh()
                out += step(state, row)
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, schema)


def front_run_step(state: FrontRunState, row: dict) -> list[dict]:
    hits = state.add(row["order_id"], row["account_id"], row["rel"], row["qty"], row["timestamp_ns"])
    base = {k: row[k] for k in ("instrument_id", "side", "seq", "order_id", "account_id")}
    return [{**base, "prior_order": o, "prior_account": a, "window_start_ns": t, "window_end_ns": row["timestamp_ns"]} for o, a, t in hits]


def stats_step(state: RunningStats, row: dict) -> list[dict]:
    got = state.add(row["qty"])
    return [{**{k: row[k] for k in ("account_id", "instrument_id", "seq", "order_id", "timestamp_ns")}, **got}] if got else []


def with_relations(events: DataFrame, entities: DataFrame) -> DataFrame:
    """New orders with rel, the relation keys of their account."""
    keys = relation_keys(entities).groupBy("account_id").agg(F.collect_set("key").alias("rel"))
    new = require_unlabelled(events).filter("status = 'New'")
    return new.join(keys, "account_id", "left").select("instrument_id", "side", "seq", "order_id", "account_id", "rel", "qty", "timestamp_ns")


def front_running_pairs(events: DataFrame, entities: DataFrame) -> DataFrame:
    """PAIRS of front running in processing order; equals the interval join where time never goes back."""
    return over_keys(with_relations(events, entities), ["instrument_id", "side"], FrontRunState, front_run_step, PAIRS)


def outliers(events: DataFrame) -> DataFrame:
    rows = require_unlabelled(events).filter("status = 'New'").select("account_id", "instrument_id", "seq", "order_id", "qty", "timestamp_ns")
    return over_keys(rows, ["account_id", "instrument_id"], RunningStats, stats_step, OUTLIERS)
