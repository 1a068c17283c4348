"""Tables, reports and scalar expressions."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tapewatch.functions import scalars
from tapewatch.operators import book, evaluation, reports
from tapewatch.sources import files, generator


def test_tables(spark):
    reports.create_tables(spark, "surveillance")
    reports.create_tables(spark, "surveillance")
    rows = spark.createDataFrame([(1, "WashTradeDetector", 1.0, "A", ["X"], ["O"], 5, 6_000_000_000, "e", None, None)], ", ".join(reports.ALERT_TABLE.split(", ")[:-2]))
    files.with_event_time(rows, "window_end_ns").write.insertInto("surveillance.alerts")
    assert reports.alive(spark) and str(spark.table("surveillance.alerts").first().event_date) == "1970-01-01"
    reports.set_status(spark, "surveillance", 1, "ESCALATED")
    reports.set_status(spark, "surveillance", 1, "CLOSED")
    assert spark.table("surveillance.alert_status").agg(F.max_by("status", "version")).first()[0] == "CLOSED"
    with pytest.raises(ValueError):
        reports.set_status(spark, "surveillance", 1, "DONE")
    with pytest.raises(KeyError):
        reports.set_status(spark, "surveillance", 2, "OPEN")
    assert reports.system_status(spark.table("surveillance.alerts")).first().by_detector == {"WashTradeDetector": 1}
    reports.empty_tables(spark, "surveillance")
    assert spark.table("surveillance.alerts").count() == 0 and reports.system_status(spark.table("surveillance.alerts")).first().n_alerts == 0


def test_no_status_is_lost_among_several_writers(spark):
    reports.create_tables(spark, "cases")
    rows = spark.createDataFrame([(k, "WashTradeDetector", 1.0, "A", ["X"], ["O"], 5, 6_000_000_000, "e", None, None) for k in (1, 2)], ", ".join(reports.ALERT_TABLE.split(", ")[:-2]))
    files.with_event_time(rows, "window_end_ns").write.insertInto("cases.alerts")
    work = [(1 + k % 2, status) for k, status in enumerate(["ESCALATED", "CLOSED", "OPEN", "UNDER_REVIEW"] * 4)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda w: reports.set_status(spark, "cases", *w), work))
    for alert in (1, 2):
        assert sorted(v for (a, _), v in zip(work, versions) if a == alert) == list(range(1, 9))
    got = {(r.alert_id, r.version): r.status for r in spark.table("cases.alert_status").collect()}
    assert got == {(a, v): status for (a, status), v in zip(work, versions)}
    assert not reports.created(spark, spark.sql("DESCRIBE TABLE EXTENDED cases.alert_status").filter("col_name = 'Location'").first().data_type + "/case-1-1.json", "")
    reports.empty_tables(spark, "cases")
    assert spark.table("cases.alert_status").count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("d", "A", True, 0.9), ("d", "B", True, None), ("d", "C", True, None), ("e", "X", False, None)], "detector_name string, id string, is_abuse boolean, score double")
    got = {(r := json.loads(x.json))["detector_name"]: r for x in reports.evaluation_json(evaluation.confusion(rows, F.lit(0.5))).collect()}
    assert got["d"]["recall"] == 0.333333 and got["d"]["precision"] == 1 and got["e"]["recall"] is None
    facts = json.loads(reports.facts_json(a=spark.range(2), b=spark.range(1)).first().a)
    assert sorted(r["id"] for r in facts) == [0, 1]
    case = generator.enforcement_case(spark)
    assert reports.account_cancels(case, "LAYERER").first().n_cancels == 25
    depth = reports.depth_json(book.replay(case, "snapshots")).first()
    assert (depth.instrument_id, depth.sequence, len(depth.bids), depth.asks) == ("ES", 61, 1, [])
    assert tuple(reports.latency(spark.range(1, 102).toDF("ns"), "ns").first()) == (51.0, 51.0, 100.0, 101)


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    assert [v(scalars.clamp01(F.lit(x))) for x in (-1.0, 0.5, 2.0)] == [0.0, 0.5, 1.0]
    assert v(scalars.lerp(2.0, 4.0, F.lit(0.25))) == 2.5 and v(scalars.round_to_tick(F.lit(1.13), F.lit(0.25))) == 1.25 and v(scalars.round_to_tick(F.lit(1.13), F.lit(0.0))) == 1.13
    assert v(scalars.whole_quantity(F.lit("2.5"))) == 3 and v(scalars.logistic(F.lit(0.0))) == 0.5 and v(scalars.numbered_id("ORD", F.lit(7))) == "ORD-000007"
    assert v(scalars.exponential_gap(F.lit(0.0), F.lit(3.0))) == 0 and len(v(scalars.config_version("v-", F.lit("x")))) == 14
    rates = spark.createDataFrame([(3, 0.8), (250, 0.016), (9, 0.5)], "rate int, precision double")
    assert round(scalars.first_over_last(rates, "rate", "precision").first().factor, 6) == 50
    odd = [k / 640 for k in range(700)] + [(2 * k + 1) / 2e6 for k in range(0, 60_000, 7)] + [0.5**20, 1.5 * 0.5**7 / 1e6, 123456.7890625, -0.5203125, -0.0359375, 0.0, 3e8 + 0.3]
    got = spark.createDataFrame([(float(x),) for x in odd], "x double").select("x", scalars.fixed6(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.x:.6f}" for r in got]
    shares = rates.withColumn("w", scalars.share_of_largest("precision"))
    assert max(r.w for r in shares.collect()) == 1.0
