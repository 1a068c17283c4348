"""How well detectors find labelled abuse: universes, confusion matrices and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.schemas import DETECTORS

#: What each detector is measured on: kind of ids, and the pattern that it should find ("any": every pattern).
SPECS = (
    ("WashTradeDetector", "execution", "WashTrade"), ("SpoofingLayeringDetector", "cancel", "SpoofingLayering"), ("MarkingTheCloseDetector", "execution", "MarkingTheClose"),
    ("FrontRunningDetector", "new", "FrontRunning"), ("StatisticalBaselineDetector", "new", "any"),
)


def universes(labelled: DataFrame) -> DataFrame:
    """universe, id and pattern: the distinct ids of each kind with their label."""
    kind = F.when(F.col("kind") == "execution", "execution").when(F.col("status") == "Cancelled", "cancel").otherwise("new")
    ident = F.when(F.col("kind") == "execution", F.col("trade_id")).otherwise(F.col("order_id"))
    return labelled.select(kind.alias("universe"), ident.alias("id"), F.col("gt_pattern").alias("pattern")).distinct()


def flagged(alerts: DataFrame) -> DataFrame:
    """detector_name, id and the best score with which the detector named that id."""
    return alerts.select("detector_name", "score", F.explode("order_ids").alias("id")).groupBy("detector_name", "id").agg(F.max("score").alias("score"))


def outcomes(ids: DataFrame, alerts: DataFrame) -> DataFrame:
    """detector_name, id, is_abuse and score (null: not flagged) for every id of each detector's universe."""
    spark = ids.sparkSession
    specs = spark.createDataFrame(SPECS, "detector_name string, universe string, target string")
    rows = ids.join(F.broadcast(specs), "universe")  # one row a detector
    hit = flagged(alerts)
    abuse = F.when(F.col("target") == "any", F.col("pattern") != "None").otherwise(F.col("pattern") == F.col("target"))
    return rows.join(hit, ["detector_name", "id"], "left").select("detector_name", "id", abuse.alias("is_abuse"), "score")


def rates(matrix: DataFrame) -> DataFrame:
    """matrix (tp, fp, fn, tn) with precision, recall and f1; null where the denominator is 0."""
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    out = matrix.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(rows: DataFrame, threshold, keys: tuple[str, ...] = ("detector_name",)) -> DataFrame:
    """tp, fp, fn, tn by keys; an id is predicted if its score reaches threshold."""
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    n = lambda c: F.count_if(c)
    y = F.col("is_abuse")
    return rates(rows.groupBy(*keys).agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn")))


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """The confusion matrix at each threshold: counts by score first, so that no row is copied for a threshold."""
    spark = rows.sparkSession
    steps = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    tallies = rows.groupBy("detector_name", "is_abuse", "score").agg(F.count(F.lit(1)).alias("n"))
    each = tallies.join(F.broadcast(steps))  # as many rows as thresholds
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    y = F.col("is_abuse")
    return rates(each.groupBy("detector_name", "threshold").agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn")))


def window_truth(windows: DataFrame, abuse: DataFrame, span_ns: int = 60_000_000_000) -> DataFrame:
    """windows (account_id, instrument_id, timestamp_ns, ...) with is_abuse: whether the key has an abuse event in [t - span, t].

    Both sides are bucketed by span, so that each window looks at two buckets of its key.
    """
    rows = windows.withColumn("_w", F.monotonically_increasing_id())
    bucket = lambda c: F.expr(f"{c} div {span_ns}")
    probe = rows.select("_w", "account_id", "instrument_id", "timestamp_ns", F.explode(F.array(bucket("timestamp_ns"), bucket("timestamp_ns") - 1)).alias("_b"))
    events = abuse.select("account_id", "instrument_id", F.col("timestamp_ns").alias("_t"), bucket("timestamp_ns").alias("_b"))
    near = (F.col("_t") <= F.col("timestamp_ns")) & (F.col("_t") >= F.col("timestamp_ns") - span_ns)
    hit = probe.join(events, ["account_id", "instrument_id", "_b"]).filter(near).select("_w").distinct().withColumn("is_abuse", F.lit(True))
    return rows.join(hit, "_w", "left").withColumn("is_abuse", F.coalesce("is_abuse", F.lit(False))).drop("_w")


def key_collisions(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which more than one scenario lies."""
    return labelled.filter("gt_scenario_id != ''").groupBy(*keys).agg(F.countDistinct("gt_scenario_id").alias("n_scenarios")).filter("n_scenarios > 1")


def detector_order() -> dict[str, int]:
    return {d: i + 1 for i, d in enumerate(DETECTORS)}
