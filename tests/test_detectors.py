"""Relation, wash trades, closing volume, front running, z-scores and flow windows against hand-computed values."""

import numpy as np
import pytest

from tapewatch.functions.schemas import ENTITY
from tapewatch.operators import anomaly, detectors, keyed, relations

S = 1_000_000_000
EXEC = "trade_id string, order_id string, account_id string, counterparty_account_id string, instrument_id string, side string, price double, qty bigint, timestamp_ns bigint, is_exec int, idx bigint"


def entities(spark, *rows):
    return spark.createDataFrame([(a, o, "Client", links) for a, o, links in rows], ENTITY)


def fills(spark, *rows, instrument="ACME"):
    return spark.createDataFrame([(f"EXE-{a}-{t}", f"ORD-{i}", a, c, instrument, "Buy", 1.0, q, int(t * S), 1, i) for i, (a, c, q, t) in enumerate(rows)], EXEC)


def orders(spark, *rows):
    return spark.createDataFrame([(o, a, "ACME", side, q, int(t * S), 0, i) for i, (o, a, side, q, t) in enumerate(rows)], "order_id string, account_id string, instrument_id string, side string, qty bigint, timestamp_ns bigint, is_exec int, idx bigint")


def test_relation_and_wash_trades(spark):
    ents = entities(spark, ("A", "O1", []), ("B", "O1", []), ("C", "O2", ["D"]), ("D", "O3", []), ("E", "", []), ("F", "", []))
    rows = [("A", "B", 1, 1), ("C", "D", 1, 2), ("D", "C", 1, 3), ("Z", "Z", 1, 4), ("A", "C", 1, 5), ("E", "F", 1, 6), ("Y", "X", 1, 7), ("A", "", 1, 8), ("A", None, 1, 9)]
    got = detectors.wash_trades(fills(spark, *rows), ents).collect()
    assert sorted(tuple(r.account_ids) for r in got) == [("A", "B"), ("C", "D"), ("D", "C"), ("Z", "Z")] and all(r.score == 1.0 for r in got)
    assert {(r.account_a, r.account_b) for r in relations.related_pairs(ents).collect()} == {("A", "B"), ("C", "D")}
    chain = entities(spark, ("A", "O1", []), ("B", "O1", ["C"]), ("C", "O2", []), ("D", "O3", []))
    assert {r.account_id: r.component_id for r in relations.account_components(chain).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}


def mtc(spark, rows, ents=()):
    close = spark.createDataFrame([("ACME", 100 * S)], "instrument_id string, session_close_ns bigint")
    found = detectors.marking_the_close(fills(spark, *rows), entities(spark, *(ents or [("nobody", "", [])])), close, 10 * S)
    return found.orderBy("window_end_ns", "emission").collect()


DOMINANT = [("BASE1", "BASE2", 400, 91), ("BASE3", "BASE4", 100, 92), ("DOMINANT", "OTHER5", 600, 95)]
LINKED = [("BASE1", "BASE2", 1000, 90.5), ("LINKED-A", "OTHER-A", 500, 91), ("LINKED-B", "OTHER-B", 500, 93)]
OWNED = [(f"LINKED-{x}", "OWNER1", []) for x in "ABC"]


def test_marking_the_close(spark):
    got = mtc(spark, [*DOMINANT, ("DOMINANT", "OTHER6", 200, 96)])
    assert [(r.account_ids, round(r.score, 6)) for r in got][:2] == [(["DOMINANT"], round(600 / 1100, 6)), (["OTHER5"], round(600 / 1100, 6))]
    assert sum("DOMINANT" in r.account_ids for r in got) == 1
    (one, *_) = mtc(spark, [("DOMINANT", "OTHER1", 300, 91), ("DOMINANT", "OTHER2", 300, 95)])
    assert one.order_ids == ["EXE-DOMINANT-91", "EXE-DOMINANT-95"]
    assert mtc(spark, [("P1", "P2", 200, 91), ("P3", "P4", 200, 92), ("P5", "P6", 200, 93)]) == []
    assert mtc(spark, [("P1", "P2", 900, 50), ("P1", "P2", 900, 100.000000001)]) == []
    got = mtc(spark, LINKED, OWNED)
    group = [r for r in got if "LINKED-A" in r.account_ids]
    assert [(r.account_ids, r.score) for r in group] == [(["LINKED-A", "LINKED-B"], 0.5)] and "volume=1000 / total=2000" in group[0].evidence and "group_size=2" in group[0].evidence
    assert len([r for r in mtc(spark, [*LINKED, ("LINKED-C", "OTHER-C", 600, 95)], OWNED) if any("LINKED" in a for a in r.account_ids)]) == 1


PAIR = [("CLIENT", "O1", ["RELATED"]), ("RELATED", "O2", [])]


@pytest.mark.parametrize(("rows", "want"), [
    ([("C1", "CLIENT", "Buy", 1000, 1), ("R1", "RELATED", "Buy", 150, 1.5)], [["C1", "R1"]]),
    ([("C1", "CLIENT", "Buy", 1000, 1), ("C2", "CLIENT", "Buy", 1500, 1.2), ("R1", "RELATED", "Buy", 150, 1.5)], [["C1", "R1"], ["C2", "R1"]]),
    ([("C1", "CLIENT", "Buy", 1000, 1), ("R1", "CLIENT", "Buy", 150, 1.5)], []),
    ([("C1", "CLIENT", "Buy", 1000, 1), ("R1", "RELATED", "Sell", 150, 1.5)], []),
    ([("C1", "CLIENT", "Buy", 1000, 1), ("R1", "STRANGER", "Buy", 150, 1.5)], []),
    ([("C1", "CLIENT", "Buy", 999, 1), ("R1", "RELATED", "Buy", 150, 1.5)], []),
    ([("C1", "CLIENT", "Buy", 1000, 1), ("R1", "RELATED", "Buy", 201, 1.5)], []),
    ([("C1", "CLIENT", "Buy", 1000, 1), ("R1", "RELATED", "Buy", 150, 3)], [["C1", "R1"]]),
    ([("C1", "CLIENT", "Buy", 1000, 1), ("R1", "RELATED", "Buy", 150, 3.000000001)], []),
    ([("C1", "CLIENT", "Buy", 1000, 3), ("R1", "RELATED", "Buy", 150, 1)], []),
])
def test_front_running(spark, rows, want):
    got = detectors.front_running(orders(spark, *rows), entities(spark, *PAIR)).orderBy("emission").collect()
    assert [r.order_ids for r in got] == want


def test_zscore(spark):
    rows = [(f"O{i}", "A", "Buy", q, i) for i, q in enumerate([100, 200, 100, 200, 100])]
    hit = detectors.zscore_alerts(orders(spark, *rows, ("X", "A", "Buy", 500, 9))).collect()
    assert [(r.order_ids, r.score) for r in hit] == [(["X"], 1.0)] and "mean=140.000000" in hit[0].evidence and "(n=5)" in hit[0].evidence
    assert detectors.zscore_alerts(orders(spark, *rows, ("X", "A", "Buy", 200, 9))).count() == 0
    assert detectors.zscore_alerts(orders(spark, *rows, ("X", "A", "Buy", 200, 9)), threshold=1.0).first().score > 0.5
    assert detectors.zscore_alerts(orders(spark, *rows[:4], ("X", "A", "Buy", 9000, 9))).count() == 0
    assert detectors.zscore_alerts(orders(spark, *((f"O{i}", "A", "Buy", 7, i) for i in range(5)), ("X", "A", "Buy", 9000, 9))).count() == 0


def test_flow_windows():
    w = anomaly.FlowWindow()
    got = [w.add("New", 100, 1000 + i) for i in range(5)]
    assert got[:4] == [None] * 4 and (got[4]["order_count"], got[4]["total_qty"], got[4]["avg_qty"]) == (5, 500, 100)
    assert w.add("Cancelled", 0, 1010)["cancel_ratio"] == 0.2  # a cancel while the count stands at 5 is scored again
    assert [bool(w.add("New", 1, 500 + i)) for i in range(5)] == [False] * 4 + [True]  # time went back: a new window
    assert w.add("New", 1, 504 + 60 * S + 1) is None and w.count == 1
    assert w.add("New", 1, 504 + 120 * S + 1) is None and w.count == 2  # exactly 60 s stays


def test_isolation_forest(spark):
    forest = anomaly.default_forest()
    typical, extreme = [25.0, 3750.0, 150.0, 0.2, 25 / 60], [50000.0, 5e7, 1000.0, 0.99, 50000 / 60]
    a, b = forest.scores(np.array([typical, extreme], float))
    assert 0 <= a < 0.5 < b <= 1
    again = anomaly.grow_forest(anomaly.training_features(), 100, 256, 42)
    assert np.array_equal(again.scores(anomaly.training_features()[:50]), forest.scores(anomaly.training_features()[:50]))
    df = spark.createDataFrame([("A", "I", 1, *typical), ("B", "I", 2, *extreme)], "account_id string, instrument_id string, timestamp_ns bigint, order_count double, total_qty double, avg_qty double, cancel_ratio double, orders_per_second double").selectExpr("*", "1L as seq")
    out = {r.account_id: r for r in anomaly.score_features(df).collect()}
    assert abs(out["A"].anomaly_score - a) < 1e-12 and out["B"].model_version.startswith("isoforest-") and len(out["B"].model_version) == 22
    assert [r.account_ids for r in anomaly.anomaly_alerts(anomaly.score_features(df), 0.5).collect()] == [["B"]]
    arr = spark.createDataFrame([({"total_qty": 3.0, "other": 9.0},)], "m map<string,double>").select(anomaly.feature_array(__import__("pyspark").sql.functions.col("m")).alias("a")).first().a
    assert arr == [0.0, 3.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(("rows", "want"), [
    ([("C1", "CLIENT", 1000, 5), ("R1", "RELATED", 150, 1), ("C2", "CLIENT", 1000, 1.1), ("R2", "RELATED", 150, 1.5)], ["C2>R2"]),
    ([("C1", "CLIENT", 1000, 1.1), ("R1", "RELATED", 150, 1.0), ("R2", "RELATED", 150, 1.5)], ["C1>R2"]),
    ([("C1", "CLIENT", 1000, 1), ("C2", "CLIENT", 1500, 1.2), ("R1", "RELATED", 150, 1.5)], ["C1>R1", "C2>R1"]),
    ([("C1", "CLIENT", 1000, 5), ("R1", "RELATED", 150, 1)], []),
])
def test_front_running_when_time_goes_back(rows, want):
    rel = {"CLIENT": ["k"], "RELATED": ["k"]}
    state, got = keyed.FrontRunState(), []
    for order, account, qty, t in rows:
        got += [f"{o}>{order}" for o, *_ in state.add(order, account, rel[account], qty, int(t * S))]
    assert got == want


def test_running_stats():
    s = keyed.RunningStats()
    assert [s.add(q) for q in (100, 200, 100, 200, 100)] == [None] * 5
    assert (s.mean, round(s.m2 / (s.n - 1), 6)) == (140.0, 3000.0)
    assert s.add(500)["score"] == 1.0 and s.add(150) is None
