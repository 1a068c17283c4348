"""Order-flow features of accounts and an isolation forest that scores them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.schemas import require_unlabelled

FEATURES = ("order_count", "total_qty", "avg_qty", "cancel_ratio", "orders_per_second")
WINDOW_NS, MIN_ORDERS, EVERY = 60_000_000_000, 5, 5
FOREST = {"n_estimators": 100, "max_samples": 256, "seed": 42, "n_train": 4000}
FEATURE_ROWS = "account_id string, instrument_id string, seq bigint, timestamp_ns bigint, order_count bigint, total_qty bigint, avg_qty double, cancel_ratio double, orders_per_second double"


class FlowWindow:
    """The window of one account and instrument: it starts with its first order, and anew after a gap or a step back."""

    def __init__(self) -> None:
        self.start = self.count = self.qty = self.cancels = 0

    def add(self, status: str, qty: int, ts: int) -> dict | None:
        """The features to score after this order, if there are any."""
        if self.start == 0 or ts < self.start or ts - self.start > WINDOW_NS:
            self.start, self.count, self.qty, self.cancels = ts, 0, 0, 0
        if status == "New":
            self.count += 1
            self.qty += qty
        elif status == "Cancelled":
            self.cancels += 1
        if self.count < MIN_ORDERS or self.count % EVERY:
            return None
        n = self.count
        return {"order_count": n, "total_qty": self.qty, "avg_qty": self.qty / n, "cancel_ratio": self.cancels / n, "orders_per_second": n / (WINDOW_NS / 1e9)}


def flow_features(events: DataFrame) -> DataFrame:
    """FEATURE_ROWS of all order events (with a column seq): one each time that a window is due to be scored.

    The windows chain from reset to reset, which no window function expresses; each partition
    holds whole keys in seq order and is read as a stream, with the state of one key at a time.
    """
    require_unlabelled(events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, window = None, FlowWindow()
        for b in batches:
            out = []
            for account, instrument, seq, status, qty, ts in zip(*(c.to_pylist() for c in b.columns)):
                if (account, instrument) != at:
                    at, window = (account, instrument), FlowWindow()
                got = window.add(status, qty, ts)
                if got:
                    out.append({"account_id": account, "instrument_id": instrument, "seq": seq, "timestamp_ns": ts, **got})
            kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
            yield pa.RecordBatch.from_pylist(out, pa.schema([(n, kinds[k]) for n, k in (f.split() for f in FEATURE_ROWS.split(", "))]))

    rows = events.filter("kind = 'order'").select("account_id", "instrument_id", "seq", "status", "qty", "timestamp_ns")
    return rows.repartition("account_id", "instrument_id").sortWithinPartitions("account_id", "instrument_id", "seq").mapInArrow(run, FEATURE_ROWS)


def training_features(n: int = FOREST["n_train"], seed: int = FOREST["seed"]) -> np.ndarray:
    """Typical order flow: skewed counts and sizes, few cancels."""
    rng = np.random.default_rng(seed)
    count = np.maximum(1, np.round(rng.lognormal(3.2, 0.6, n)))
    average = rng.lognormal(5.0, 0.5, n)
    total = count * average * rng.normal(1.0, 0.05, n)
    return np.column_stack([count, total, average, rng.beta(2, 8, n), count / 60.0])


@dataclass
class Forest:
    """Isolation trees (Liu, Ting and Zhou, 2008) as arrays: feature (-1: leaf), cut, children, depth with the leaf's correction."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, above 0.5 for rows that are easier to isolate than typical ones."""
        depth = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                i = np.flatnonzero(inner)
                at = node[i]
                node[i] = np.where(x[i, feature[at]] < cut[at], left[at], right[at])
            depth += path[node]
        decision = 0.5 - 2.0 ** (-(depth / len(self.trees)) / average_path(self.sample))
        return 1 / (1 + np.exp(4 * decision))


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, n_trees: int, sample: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    limit, trees = int(np.ceil(np.log2(max(sample, 2)))), []
    for _ in range(n_trees):
        feature, cut, left, right, path = [], [], [], [], []
        todo = [(x[rng.choice(len(x), sample, replace=False)], 0, -1, False)]
        while todo:
            rows, depth, parent, is_right = todo.pop()
            me = len(feature)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            low, high = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(high > low)
            for a, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (path, depth + average_path(len(rows)))):
                a.append(v)
            if depth >= limit or len(rows) <= 1 or not len(open_):
                continue
            feature[me] = int(rng.choice(open_))
            cut[me] = float(rng.uniform(low[feature[me]], high[feature[me]]))
            below = rows[:, feature[me]] < cut[me]
            todo += [(rows[below], depth + 1, me, False), (rows[~below], depth + 1, me, True)]
        trees.append(tuple(np.array(a) for a in (feature, cut, left, right, path)))
    return Forest(trees, sample)


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return grow_forest(training_features(), FOREST["n_estimators"], FOREST["max_samples"], FOREST["seed"])


def model_version() -> str:
    return "isoforest-" + hashlib.sha256(json.dumps(FOREST, sort_keys=True).encode()).hexdigest()[:12]


def feature_array(features: Column) -> Column:
    """The features in their fixed order from a map; missing ones are 0, unknown ones ignored."""
    return F.array(*(F.coalesce(F.try_element_at(features, F.lit(f)), F.lit(0.0)) for f in FEATURES))


def score_features(rows: DataFrame) -> DataFrame:
    """rows (with FEATURES as columns) with anomaly_score and model_version; the forest is a few hundred KB."""
    forest = default_forest()

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.column_stack([v.fillna(0).to_numpy(float) for v in (a, b, c, d, e)])))

    return rows.withColumns({"anomaly_score": score(*FEATURES), "model_version": F.lit(model_version())})


def anomaly_alerts(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    said = F.concat(F.lit("Isolation Forest anomaly_score="), F.format_string("%.6f", "anomaly_score"), F.lit(" model_version="), "model_version")
    return scored.filter(F.col("anomaly_score") >= threshold).select(
        F.lit("MlAnomalyDetector").alias("detector_name"), F.col("anomaly_score").alias("score"), "instrument_id", F.array("account_id").alias("account_ids"), F.array().cast("array<string>").alias("order_ids"),
        F.col("timestamp_ns").alias("window_start_ns"), F.col("timestamp_ns").alias("window_end_ns"), said.alias("evidence"), "model_version", "seq",
    )
