"""Alert store, evidence, codecs, market statistics, evaluation and the generator."""

import json

import pytest
from pyspark.sql import functions as F

from tapewatch.functions.storage import numbered
from tapewatch.operators import alerts as store
from tapewatch.operators import calibration, detectors, evaluation
from tapewatch.plans import forms
from tapewatch.sources import files, fix, generator

S = 1_000_000_000
ALERT = "alert_id bigint, detector_name string, instrument_id string, account_ids array<string>, window_start_ns bigint, window_end_ns bigint, score double, evidence string"
FOUR = [(1, "WashTradeDetector", "A", ["ACC-1"], 1 * S), (2, "SpoofingLayeringDetector", "B", ["ACC-2"], 2 * S), (3, "WashTradeDetector", "A", ["ACC-1", "ACC-3"], 3 * S), (4, "FrontRunningDetector", "C", ["ACC-4"], 4 * S)]


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(*r, r[-1] + 5, 0.2 * r[0], "x") for r in FOUR], ALERT).persist()


def ids(df):
    return [r.alert_id for r in df.collect()]


def test_alert_queries(four):
    assert sorted(ids(store.find_alerts(four, start_ns=3 * S // 2, end_ns=7 * S // 2))) == [2, 3]
    assert ids(store.dispatch(four, account="ACC-1")) == [1, 3] and ids(store.dispatch(four, detector="WashTradeDetector")) == [1, 3]
    assert ids(store.dispatch(four)) == [4, 3, 2, 1] and ids(store.recent_alerts(four, 2)) == [4, 3]
    page = store.dispatch(four, offset=1, limit=2, detector="WashTradeDetector").collect()
    assert [(r.alert_id, r.total_count) for r in page] == [(1, 2)]
    assert ids(store.dispatch(four, start_ns=2 * S)) == [2, 3, 4] and ids(store.find_alerts(four, alert_id=9)) == []
    assert sorted(ids(store.search_alerts(four, "WASH"))) == [1, 3] and ids(store.search_alerts(four, "acc-4")) == [4]
    assert [r.s for r in four.orderBy("alert_id").select(store.severity(F.col("score")).alias("s")).collect()] == ["Low", "Warning", "Warning", "Serious"]
    assert [round(r.position, 4) for r in store.timeline(four).orderBy("alert_id").collect()] == [0.0, 0.3333, 0.6667, 1.0]


def test_case_status(spark, four):
    log = spark.createDataFrame([(1, 1, "CLOSED"), (1, 2, "OPEN"), (2, 1, "ESCALATED")], "alert_id bigint, version int, status string")
    assert {r.alert_id: r.status for r in store.latest_status(four, log).collect()} == {1: "OPEN", 2: "ESCALATED", 3: "OPEN", 4: "OPEN"}
    changes = spark.createDataFrame([(1, 3, "CLOSED"), (9, 1, "OPEN"), (2, 2, "DONE")], "alert_id bigint, version int, status string")
    assert {r.alert_id: r.error for r in store.status_changes(changes, four).collect()} == {1: None, 9: "no such alert", 2: "no such status"}
    assert spark.range(1).select(store.allowed_next(F.lit("CLOSED")).alias("n")).first().n == ["OPEN"]


def test_evidence(spark):
    text = "depth_ratio=0.900000 speed=0.860000 opposite_price_moved_favorably=true move_score=0.976667 concurrent_same_side_orders=0 typical_concurrent=1.000000 layering_score=0.000000 time_in_book_ns=700000000"
    rows = [("SpoofingLayeringDetector", text), ("SpoofingLayeringDetector", "depth_ratio=x"), ("StatisticalBaselineDetector", "order qty=500 z=6.572671 against running mean=140.000000 stddev=54.772256 (n=5)"), ("WashTradeDetector", "prose")]
    got = [r.f for r in spark.createDataFrame(rows, "d string, e string").select(store.parse_evidence(F.col("d"), F.col("e")).alias("f")).collect()]
    assert got[0]["time_in_book_ns"] == "700000000" and got[0]["moved"] == "true" and got[1] is None and got[2]["n"] == "5" and got[3] is None
    said = spark.range(1).select(store.readable_gap(F.lit("order X (qty=3) 1500000ns after a large")).alias("a"), store.duration_text(F.lit(700_000_000)).alias("b"), store.percent_text(F.lit(0.5)).alias("c"), store.percent_text(F.lit(0.5466)).alias("d")).first()
    assert tuple(said) == ("order X (qty=3) 1.50ms after a large", "700.00ms", "50%", "54.7%")


def test_text_arrays_and_json(spark, four):
    values = ["a", 'q"uo\\te', "", "c,d {}"]
    df = spark.createDataFrame([(values,)], "v array<string>").withColumn("t", store.pg_array(F.col("v")))
    assert df.select(store.from_pg_array(F.col("t")).alias("v")).first().v == values
    out = json.loads(store.alert_json(four.withColumn("model_version", F.lit(None).cast("string"))).orderBy("alert_id").first().json)
    assert out["model_version"] is None and out["account_ids"] == ["ACC-1"]


def test_numbers_are_gapless_and_appended(spark, four, tmp_path):
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [r.n for r in numbered(many, ["k"], "n").orderBy("k").collect()] == list(range(1, 1001))
    path = str(tmp_path / "alerts")
    rows = four.drop("alert_id")
    files.append_alerts(rows.limit(3), path, ["window_end_ns"])
    files.append_alerts(rows.filter("detector_name = 'FrontRunningDetector'"), path, ["window_end_ns"])
    assert sorted(ids(spark.read.parquet(path))) == [1, 2, 3, 4] and "event_date" in spark.read.parquet(path).columns


EVENTS = "seq bigint, kind string, order_id string, orig_order_id string, trade_id string, account_id string, counterparty_account_id string, instrument_id string, side string, price double, qty bigint, status string, timestamp_ns bigint, order_type string, venue string"
FLOW = [
    (1, "order", "O1", "", None, "A", None, "ACME", "Buy", 100.25, 500, "New", 1_700_000_000_123_456_789, "Limit", "XNAS"),
    (2, "order", "O2", "", None, "B", None, "ACME", "Sell", 101.0, 7, "New", -1_500_000_000, "Market", ""),
    (3, "order", "O1", "O1", None, "A", None, "ACME", "Buy", 100.25, 500, "Cancelled", 1_700_000_001_000_000_000, "Limit", "XNAS"),
    (4, "execution", "O2", "", "T1", "B", "A", "ACME", "Sell", 101.0, 7, "", 1_700_000_002_999_000_000, "Limit", "XNAS"),
]


def test_fix_round_trip(spark):
    events = spark.createDataFrame(FLOW, EVENTS)
    got = fix.decode(fix.encode(events)).orderBy("msg_seq_num").collect()
    assert [r.error for r in got] == [None] * 4 and [r.msg_type for r in got] == ["D", "D", "F", "8"]
    for r, w in zip(got, FLOW):
        assert (r.order_id, r.account_id, r.instrument_id, r.qty) == (w[2], w[5], w[7], w[10])
        assert r.timestamp_ns == w[12] // 1_000_000 * 1_000_000
    assert got[0].price == 100.25 and got[1].order_type == "Market" and got[2].orig_order_id == "O1" and (got[3].trade_id, got[3].counterparty_account_id) == ("T1", "A")
    whole = spark.createDataFrame([(w[12],) for w in FLOW], "t bigint").withColumn("s", fix.utc_text(F.col("t")))
    assert [(r.t, r.b) for r in whole.withColumn("b", fix.utc_ns(F.col("s"))).collect()] == [(w[12], w[12]) for w in FLOW]
    assert whole.first().s == "20231114-22:13:20.123456789"


def test_malformed_messages(spark):
    good = fix.encode(spark.createDataFrame(FLOW[:1], EVENTS)).first().raw
    lines = [(good,), ("",), ("hello",), (good[: len(good) // 2],), (good.replace("38=500", "38=501"),), (good.replace("9=1", "9=2", 1),), (None,), (good.replace("\x01", "|"),)]
    got = [r.error for r in fix.decode(spark.createDataFrame(lines, "raw string").coalesce(1)).collect()]
    assert got[0] is None and got[1] == "empty" and got[2] == "not FIX 4.2" and got[3] == "truncated" and got[4] == "checksum" and got[5] == "body length" and got[6] == "empty" and got[7] == "not FIX 4.2"
    group = good.replace("\x0160=", "\x01375=P1\x01375=P2\x0160=")
    assert spark.createDataFrame([(group,)], "raw string").select(fix.field(F.col("raw"), 375).alias("c")).first().c == "P1"
    gaps = spark.createDataFrame([("s", n) for n in (1, 2, 5, 6, 9)], "session string, msg_seq_num bigint")
    assert sorted((r["last"], r["next"]) for r in fix.sequence_gaps(gaps, "session").collect()) == [(2, 5), (6, 9)]


def test_fields_are_found_without_a_pattern_for_each(spark):
    """The first value of a tag, also empty; none for a field that isn't ended. Lines are searched for some twenty tags, so no search tries alternatives."""
    lines = spark.createDataFrame([("55=A\x0155=B\x01155=C\x01",), ("1=x\x0155=\x01",), ("1=x\x0155=A",), ("55=a=\u00e9\n\x01",), ("",), (None,)], "raw string")
    assert [r[0] for r in lines.select(fix.field(F.col("raw"), 55)).collect()] == ["A", "", None, "a=\u00e9\n", None, None]
    assert "(?:^|" not in fix.decode(lines)._jdf.queryExecution().optimizedPlan().toString()


def test_event_json_round_trip(spark):
    events = spark.createDataFrame(FLOW, EVENTS)
    lines = files.encode_events(events)
    extra = spark.createDataFrame([("{not json",), ('{"type":"order","order_id":"X"}',), ('{"type":"other"}',)], "value string")
    good, bad = files.split_errors(files.decode_events(lines.unionByName(extra)))
    back = {(r.kind, r.order_id, r.status): r for r in good.collect()}
    assert back["order", "O1", "New"].timestamp_ns == 1_700_000_000_123_456_789 and back["execution", "O2", None].trade_id == "T1" and len(back) == 4
    assert sorted(r.error.split()[0] for r in bad.collect()) == ["malformed", "missing", "unknown"]


def test_labelled_files(spark, tmp_path):
    orders, executions = generator.abuse(spark, generator.Session(seed=3))
    for rows, read in ((orders, files.read_orders_csv), (executions, files.read_executions_csv)):
        path = str(tmp_path / ("o" if "status" in rows.columns else "e"))
        files.write_labelled_csv(rows, path)
        back = read(spark, path).fillna("")
        assert sorted(map(str, back.collect())) == sorted(map(str, rows.select(*back.columns).collect()))
    with pytest.raises(Exception):  # noqa: B017
        files.read_executions_csv(spark, str(tmp_path / "o")).collect()
    one = {"orders": [json.loads(r.value) for r in files.labelled_lines(orders).collect()], "executions": [json.loads(r.value) for r in files.labelled_lines(executions).collect()]}
    (tmp_path / "all.json").write_text(json.dumps(one))
    o, e = files.read_labelled_json(spark, str(tmp_path / "all.json"))
    assert o.count() == orders.count() and e.filter("gt_pattern = 'WashTrade'").count() == executions.filter("gt_pattern = 'WashTrade'").count() > 0


def test_json_documents_grow_in_number(spark, sf, monkeypatch):
    """A reader takes a document whole, so more rows make more documents and no larger ones."""
    monkeypatch.setattr(forms, "DOCUMENT_ROWS", 20)
    rows = forms.labelled_json(spark, sf)
    n, sizes = rows.count(), [r.n for r in rows.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > n / 40 and max(sizes) < 80


def test_market_files_and_statistics(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sym_root,date,time_m,price,size\nA,d,11:00:00.123456789,10,5\nA,d,11:00:01,11,0\nA,d,11:00:02.5,12,7\n")
    (tmp_path / "q.csv").write_text("sym_root,date,time_m,bid,ask,bidsiz\nA,d,11:00:00,9,10,1\nA,d,11:00:01,9,10,0\nA,d,11:00:02,9,10,3\n")
    trades, dropped = files.sized(files.read_market_csv(spark, str(tmp_path / "t.csv"), "trades"), "size")
    quotes, gone = files.sized(files.read_market_csv(spark, str(tmp_path / "q.csv"), "quotes"), "bidsiz", "asksiz")
    assert (trades.count(), dropped.first().dropped, quotes.count(), gone.first().dropped) == (2, 1, 2, 1)
    assert trades.orderBy("time_us").first().time_us == 39_600_123_456
    kind = "symbol string, date string, time_us bigint, price double, size bigint, trade_no bigint"
    rows = [("BAD", "d", i, p, 1, i) for i, p in enumerate([220.0, 220.1, 509.48, 220.2])] + [("GOOD", "d", i, p, 1, i) for i, p in enumerate([100.0, 108.0])]
    moves = calibration.price_moves(spark.createDataFrame(rows, kind))
    assert moves.count() == 4 and moves.filter("dropped").count() == 2
    assert round(moves.filter("symbol = 'GOOD'").first().ticks, 6) == 800
    t = spark.createDataFrame([(s, "d", us, 1.0, 1, us) for s in "AB" for us in (0, 30_000_000, 90_000_000)], kind)
    none = spark.createDataFrame([], "symbol string, date string, time_us bigint")
    q = spark.createDataFrame([("A", "d", 120_000_000), ("A", "d", 10), ("B", "d", 10)], "symbol string, date string, time_us bigint")
    assert calibration.arrival_rate(t, none).first().window_seconds == 90.0
    assert calibration.arrival_rate(t, q).first().window_seconds == 105.0
    half = calibration.nearest_rank(spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 6)], "v int"), "v").first()
    assert (half.p10, half.p25, half.p50, half.p90, half.n) == (1, 2, 3, 5, 6)  # 0.5, 1.25, 2.5 and 4.5: halves go to the even index


def test_evaluation(spark):
    rows = spark.createDataFrame([("d", "A", True, 0.9), ("d", "B", True, None), ("d", "C", False, 0.7), ("d", "D", False, None), ("e", "X", False, None)], "detector_name string, id string, is_abuse boolean, score double")
    got = {r.detector_name: r for r in evaluation.confusion(rows, F.lit(0.5)).collect()}
    assert tuple(got["d"])[1:] == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(got["e"])[1:] == (0, 0, 0, 1, None, None, None)
    sweep = {r.threshold: r.tp + r.fp for r in evaluation.threshold_sweep(rows.filter("detector_name = 'd'"), [0.0, 0.8, 1.0]).collect()}
    assert sweep == {0.0: 2, 0.8: 1, 1.0: 0}


def test_generated_session(spark):
    s = generator.Session(seed=12345, seconds=60, orders_per_second=2, n_equity=2, n_fx=0, n_fixed_income=0)
    orders, executions = (df.persist() for df in generator.session(spark, s))
    again = generator.session(spark, s)[0]
    assert orders.exceptAll(again).count() == 0 and again.exceptAll(orders).count() == 0
    assert {r.gt_pattern for r in orders.select("gt_pattern").distinct().collect()} == {"None", *generator.SCENARIOS}
    ents = generator.accounts(spark, s)
    pairs = ents.filter("size(linked_account_ids) = 1")
    assert ents.count() == 30 and pairs.count() == 10 and pairs.select("owner_id").distinct().count() == 5
    events = numbered(generator.to_events(orders, executions), ["timestamp_ns", "is_exec", "idx"], "seq").persist()
    assert not [c for c in events.columns if c.startswith("gt_")]
    wash = detectors.wash_trades(events.filter("kind = 'execution'"), ents)
    found = {x for r in wash.collect() for x in r.order_ids}
    labelled = {r.trade_id for r in executions.filter("gt_pattern = 'WashTrade'").collect()}
    assert labelled <= found
    close = generator.instruments(spark, s).select("instrument_id", "session_close_ns")
    assert any("FrontRunning" in i for r in detectors.front_running(events.filter("status = 'New'"), ents).collect() for i in r.order_ids)
    assert any("MarkingTheClose" in i for r in detectors.marking_the_close(events.filter("kind = 'execution'"), ents, close).collect() for i in r.order_ids)
    from tapewatch.operators import book

    assert book.replay(events, "trace").filter("skipped").count() <= events.filter("status = 'Cancelled'").count()
    assert any("Spoofing" in r.order_id for r in book.replay(events, "scores", 0.5).filter("fired").collect())
    assert "SCENARIO" not in " ".join(r.evidence for r in wash.collect())


def test_reports_are_merged(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "n": 1}))
    r = files.read_reports(spark, main=str(tmp_path / "a.json"), sweep=str(tmp_path / "b.json")).first()
    assert (r.main.name, r.sweep.n) == ("a", 1)
    with pytest.raises(Exception):  # noqa: B017
        files.read_reports(spark, main=str(tmp_path / "none.json"))
