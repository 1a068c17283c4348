"""Set-based books against the keyed book on random flow, and the running values they are made of."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapewatch.functions import running
from tapewatch.functions.schemas import EVENT
from tapewatch.functions.storage import keep
from tapewatch.operators import book, book_sets, detectors, evaluation, reports
from tapewatch.plans import cases, surveillance
from tests.test_book_and_spoofing import TEN

COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
TRACE = ["instrument_id", "seq", "sequence", "skipped", "best_bid", "best_ask", "level_qty", "timestamp_ns"]


def event_rows(spark, events):
    rows = [{"seq": n + 1, "trade_id": None, "counterparty_account_id": None, "instrument_id": "A", **e} for n, e in enumerate(events)]
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], EVENT)


def random_events(n, seed, ids=40):
    """Orders, cancels, replaces and fills that name any of a few orders, so that half of them are rejected."""
    rng, out = random.Random(seed), []
    for i in range(n):
        ins = rng.choice("AAAAB")
        base = {"instrument_id": ins, "kind": "order", "status": "New", "order_id": f"O{rng.randrange(ids)}", "orig_order_id": "", "account_id": f"X{rng.randrange(3)}", "side": rng.choice(["Buy", "Sell"]), "price": 100 + rng.randrange(8) * 0.5, "qty": rng.randrange(1, 6), "timestamp_ns": i}
        other = f"O{rng.randrange(ids)}"
        k = rng.random()
        out.append(base if k < 0.35 else {**base, "status": "Cancelled", "orig_order_id": other} if k < 0.55 else {**base, "status": "Replaced", "orig_order_id": other} if k < 0.8 else {**base, "kind": "execution", "status": ""})
    return out


def places(b):
    for side in b.levels.values():
        for price, ids in side.items():
            ahead = 0
            for place, oid in enumerate(ids):
                yield price, oid, place, ahead, b.orders[oid][3]
                ahead += b.orders[oid][3]


@pytest.fixture(scope="module")
def flow():
    return random_events(1200, 7)


def test_trace_equals_the_keyed_book(spark, flow):
    events = event_rows(spark, flow)
    want = sorted(map(tuple, book.replay(events, "trace").select(TRACE).collect()))
    assert sum(r[3] for r in want) > 300
    got = book_sets.trace(events)
    assert sorted(map(tuple, got.select(TRACE).collect())) == want
    counts, books = {}, {}
    for n, e in enumerate(flow):
        b = books.setdefault(e["instrument_id"], book.Book())
        try:
            b.apply(e)
        except ValueError:
            pass
        counts[n + 1] = len(b.levels[e["side"]].get(e["price"], ()))
    assert {r.seq: r.level_orders for r in got.select("seq", "level_orders").collect()} == counts


def test_spoofing_scores_equal_the_keyed_state(spark, flow):
    events = event_rows(spark, flow)
    exact = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select([c.split()[0] for c in book.SCORES.split(", ")]).collect())
    got, want = exact(book_sets.spoof_scores(events)), exact(book.replay(events, "scores"))
    assert got == want and len(want) > 50 and 0 < sum(r[4] for r in want) < len(want)
    assert exact(detectors.spoof_scores(events, most=500)) == want == exact(detectors.spoof_scores(events))  # one of the two instruments has more


def test_chains_of_replaces_find_their_first_order(spark, monkeypatch):
    """By a few joins, without component labels, which the flow of the queries never needs; circles, forks and long chains still do."""
    chain = [(f"n{i}", f"n{i + 1}") for i in range(32)] + [("x", "y"), ("z", "z")]
    links = lambda pairs: spark.createDataFrame(pairs, "a string, b string")
    got = {r.node: r.label for r in book_sets.first_orders(links(chain)).collect()}
    assert got == {f"n{i + 1}": "n0" for i in range(32)} | {"y": "x"}
    for odd in ([("a", "b"), ("b", "a")], [("a", "c"), ("b", "c")], [(f"n{i}", f"n{i + 1}") for i in range(33)]):
        assert book_sets.first_orders(links(odd)) is None
    monkeypatch.setattr(book_sets, "component_labels", lambda links: pytest.fail("a chain was labelled as a component"))
    assert book_sets.queue(event_rows(spark, TEN)).count() == book_sets.resting_orders(event_rows(spark, TEN)).count() > 0


def test_families_are_folded_as_streams(spark, flow):
    """No life of a family is one value: a task takes a family of any length batch by batch, and its state goes on from one to the next."""
    events = event_rows(spark, flow)
    want = {r.seq: r.skipped for r in book.replay(events, "trace").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.seq: r.skipped for r in book_sets.folded(events).collect()}
        ends = book_sets.folded(events, resting=True).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and ends == book_sets.folded(events, resting=True).count() > 0
    assert not any("array" in kind for _, kind in book_sets.folded(events).dtypes)


def test_queue_keeps_and_loses_places(spark, flow):
    for events in (flow, TEN):
        books = defaultdict(book.Book)
        for e in events:
            try:
                books[e.get("instrument_id", "A")].apply(e)
            except ValueError:
                pass
        want = {(i, o): (price, place + 1, ahead, qty) for i, b in books.items() for price, o, place, ahead, qty in places(b)}
        got = book_sets.queue(event_rows(spark, events)).collect()
        assert {(r.instrument_id, r.order_id): (r.price, r.queue_position, r.qty_ahead, r.remaining) for r in got} == want


def test_no_python_and_no_exchange_by_instrument_alone(spark, sf):
    plan = book_sets.trace(surveillance.sequenced(spark, sf))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert not re.search(r"hashpartitioning\((instrument_id|key)#\d+, \d+\)", plan)


def test_empty_flow(spark):
    none = spark.createDataFrame([], EVENT)
    assert book_sets.trace(none).count() == 0 == book_sets.queue(none).count()


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_running_sums(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), p, rng.randrange(-3, 9)) for p in range(300)]
    df = keep(spark.createDataFrame(rows, "k string, p bigint, v int"))
    got = {r.p: r.total for r in running.running_sums(df, ["k"], "p", {"total": "v"}, bits).collect()}
    assert got == {p: sum(v2 for k2, p2, v2 in rows if k2 == k and p2 <= p) for k, p, _ in rows}


def test_positions(spark):
    df = spark.createDataFrame([("a", 3), (None, 1), ("a", 1), (None, 5), ("b", 2)], "k string, t int")
    got = {(r.k, r.t): r.n for r in running.with_position(df, ["k"], ["t"], "n").collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, (None, 1): 1, (None, 5): 2, ("b", 2): 1}


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_best_covers(spark, bits):
    rng = random.Random(bits)
    spans = []
    for _ in range(150):
        lo = rng.randrange(1, 200)
        spans.append((rng.choice("xy"), rng.choice(["Buy", "Sell"]), lo, rng.randrange(lo + 1, 202), float(rng.randrange(50))))
    points = [(k, p) for k in "xyz" for p in range(1, 201)]
    frame = spark.createDataFrame(spans, "key string, side string, lo bigint, hi bigint, worth double")
    got = running.best_covers(spark.createDataFrame(points, "key string, at bigint"), frame, 200, bits).collect()
    best = lambda k, p, s: max((w for k2, s2, lo, hi, w in spans if k2 == k and s2 == s and lo <= p < hi), default=None)
    assert {(r.key, r["at"]): (r.bid, r.ask) for r in got} == {(k, p): (best(k, p, "Buy"), best(k, p, "Sell")) for k, p in points}
    assert len(got) == len(points)


@pytest.mark.parametrize("bits", [1, 12])
def test_last_before(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), p, rng.choice([None, None, 1.0, 2.0])) for p in range(200)]
    df = keep(spark.createDataFrame(rows, "k string, p bigint, v double"))
    got = {r.p: r.last for r in running.last_before(df, ["k"], "p", {"last": "v"}, bits).collect()}
    assert got == {p: next((v for k2, p2, v in reversed(rows[:p]) if k2 == k and v is not None), None) for k, p, _ in rows}


def test_sums_within_a_span(spark):
    """Equal times count in full, what is exactly span old counts, and blocks and keys don't mix."""
    data = [(k, t, i % 3) for k in ("a", "b", None) for i, t in enumerate([0, 0, 5, 9, 10, 10, 15, 30, 40, 40, 41])]
    rows = spark.createDataFrame(data, "k string, t long, v long")
    got = {(r.k, r.t): r.s for r in running.sums_within(rows, ["k"], "t", 10, {"s": "v"}, bits=1).collect()}
    assert got == {(k, t): sum(v for k2, t2, v in data if k2 == k and t - 10 <= t2 <= t) for k, t, _ in data}


def test_ambient_moves_go_through_no_range_window(spark, sf):
    """A range frame sums its half minute anew for each row, and holds the instrument in one task."""
    plan = surveillance.ambient_moves(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan


def test_concurrent_orders_join_on_no_null_key(spark, sf):
    """Orders have no trade id, so a left join on it would bring all of them into one task."""
    plan = surveillance.concurrent_orders(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


def test_positions_of_few_keys_need_no_join_by_key(spark):
    """A hot instrument's rows stay where they are."""
    rows = running.with_position(spark.range(50).selectExpr("id % 2 AS k", "id AS t"), ["k"], ["t"], "at", "n")
    assert "SortMergeJoin" not in rows._jdf.queryExecution().toString()
    assert sorted((r.n, r.k, r.t, r.at) for r in rows.collect()) == [(i + 1, i // 25, 2 * (i % 25) + i // 25, i % 25 + 1) for i in range(50)]


def test_anomalies_leave_the_numbers_of_other_alerts_alone(spark, monkeypatch):
    """all_alerts is what its SQL states at any size; with alerts of the forest, all_six_alerts has those as well."""
    anomalies = detectors.anomalies
    monkeypatch.setattr(detectors, "anomalies", lambda events: anomalies(events, 0.0))
    rules = surveillance.all_alerts_flat(spark, "/root/testdata/sf0.01")
    assert (rules.count(), rules.agg({"alert_id": "max"}).first()[0]) == (465, 465) and "MlAnomalyDetector" not in {r[0] for r in rules.select("detector_name").distinct().collect()}
    six = surveillance.all_six_alerts(spark, "/root/testdata/sf0.01")
    assert (six.count(), six.filter("detector_name = 'MlAnomalyDetector'").count()) == (530, 65)


def test_forest_leaves_the_matrix_of_the_store_alone(spark, monkeypatch):
    """confusion_matrix and threshold_sweep are what their SQL states at any size; with windows of the forest raised, those of six have them."""
    monkeypatch.setattr(cases, "ML_THRESHOLD", 0.0)
    raised = lambda found: {r.tp + r.fp for r in found.filter("detector_name = 'MlAnomalyDetector'").collect()}
    sf = "/root/testdata/sf0.01"
    assert raised(cases.confusion_matrix(spark, sf)) == raised(cases.threshold_sweep(spark, sf)) == {0}
    assert raised(evaluation.confusion(cases.outcomes(spark, sf, anomalies=True), F.lit(0.0))) == {65}
    assert 65 in raised(cases.threshold_sweep_six(spark, sf))


def exploded(depth):
    """The orders of snapshots, one by one."""
    return {(r.instrument_id, r.sequence, r.last_event_timestamp_ns, side, v.price, v.total_qty, n, *o) for r in depth.collect() for side, levels in (("Buy", r.bids), ("Sell", r.asks)) for v in levels for n, o in enumerate(v.orders)}


def test_snapshots_against_the_keyed_book(spark):
    """With replaces that keep or lose their place, and rejected events among them and at the end."""
    events = event_rows(spark, random_events(900, 31))
    got = [tuple(r) for r in book_sets.snapshots(events).collect()]
    assert len(got) == len(set(got)) > 20 and set(got) == exploded(reports.depth_json(book.replay(events, "snapshots")))


def test_book_snapshots_hold_no_book(spark, sf, monkeypatch):
    monkeypatch.delattr(book, "replay")
    assert surveillance.book_snapshots(spark, sf).count() > 0
