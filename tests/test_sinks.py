"""Streams that are read while they run, alerts with gapless ids, chained scoring and counts that add up."""

import time

import pytest
from pyspark.sql import functions as F

from tapewatch.functions.storage import keep
from tapewatch.operators import anomaly, book, reports
from tapewatch.plans import amended, surveillance
from tapewatch.streaming import live, sinks


def reader(spark, events, source):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)


@pytest.fixture(scope="module")
def events(spark, sf):
    """The flow with replaces and rejects."""
    return keep(amended.amended(spark, sf).drop("event_id", "is_exec", "idx"))


@pytest.fixture(scope="module")
def parts(events):
    n = events.count()
    return [keep(events.filter(f"seq > {n * k // 3} and seq <= {n * (k + 1) // 3}").coalesce(1)) for k in range(3)]


def test_depth_and_recent_events_while_the_query_runs(spark, events, parts, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    parts[0].write.parquet(f"{source}/part0")
    query = sinks.book_stream(reader(spark, events, source)).writeStream.format("noop").option("checkpointLocation", checkpoint).start()
    try:
        for k in range(3):
            if k:
                parts[k].write.parquet(f"{source}/part{k}")
            query.processAllAvailable()
            so_far = events.filter(F.col("seq") <= parts[k].agg(F.max("seq")).first()[0])
            assert query.isActive
            depth = {r.instrument_id: r for r in sinks.live_depth(spark, checkpoint).collect()}
            assert depth == {r.instrument_id: r for r in reports.depth_json(book.replay(so_far, "snapshots")).collect()}
            skipped = {r.seq for r in book.replay(so_far, "trace").filter("skipped").collect()}
            recent = sinks.live_recent(spark, checkpoint, 5).collect()
            for name in depth:
                want = sorted((r.seq for r in so_far.filter(F.col("instrument_id") == name).collect() if r.seq not in skipped), reverse=True)[:5]
                assert [r.seq for r in sorted(recent, key=lambda r: r.recency) if r.instrument_id == name] == want
    finally:
        query.stop()


def alert_rows(spark, n, start=0):
    return spark.createDataFrame([(f"D{i}", 1_704_067_200_000_000_000 + i) for i in range(start, start + n)], "detector_name string, window_end_ns bigint")


def test_ids_stay_gapless_when_micro_batches_fail_and_repeat(spark, tmp_path):
    folder, order = str(tmp_path), ["window_end_ns"]
    sink = sinks.alert_sink(folder, order)
    assert sinks.committed(spark, folder).count() == 0
    sink(alert_rows(spark, 4), 0)
    # Micro-batch 1 fails after its rows were written and before they were committed: they are not seen.
    alert_rows(spark, 9, 50).withColumn("alert_id", F.lit(5).cast("long")).write.parquet(f"{folder}/alerts/batch=1")
    assert {r.window_end_ns % 1000 for r in sinks.stored_alerts(spark, folder).collect()} == {0, 1, 2, 3}
    for _ in range(2):  # then it runs again, and once more after its commit
        sink(alert_rows(spark, 3, 10), 1)
    sink(alert_rows(spark, 0), 2)
    sink(alert_rows(spark, 2, 20), 3)
    got = sorted((r.alert_id, r.window_end_ns % 1000) for r in sinks.stored_alerts(spark, folder).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 10), (6, 11), (7, 12), (8, 20), (9, 21)]


def test_chained_scoring_equals_batch_after_a_restart(spark, sf, tmp_path):
    events = keep(surveillance.sequenced(spark, "/root/testdata/sf0.01").drop("event_id", "is_exec", "idx"))
    n, source, folder = events.count(), str(tmp_path / "in"), str(tmp_path / "out")
    scored = anomaly.score_features(anomaly.flow_features(events))
    threshold = scored.approxQuantile("anomaly_score", [0.7], 0.0)[0]
    want = anomaly.anomaly_alerts(scored, threshold)
    columns = ["seq", "instrument_id", "account_ids", "score", "evidence"]
    for k in range(2):
        events.filter(f"seq > {n * k // 2} and seq <= {n * (k + 1) // 2}").coalesce(1).write.parquet(f"{source}/part{k}")
        stream = lambda: reader(spark, events, source)
        if not k:

            def failing(df, sinks_, checkpoint):
                raise OSError("the scorer is away")

            with pytest.raises(OSError):  # windows go on; their scores come after the restart
                sinks.scoring_chain(stream(), folder, threshold, failing)
        sinks.scoring_chain(stream(), folder, threshold, live.drain)
    got = sinks.stored_alerts(spark, f"{folder}/store")
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) and want.count() > 5
    assert sorted(r.alert_id for r in got.select("alert_id").collect()) == list(range(1, want.count() + 1))
    broken = spark.createDataFrame([("A", "I", 1, 1, 5, 5, float("nan"), 0.1, 0.1), ("A", "I", 2, 2, 5, 5, None, 0.1, 0.1)], "account_id string, instrument_id string, seq bigint, timestamp_ns bigint, order_count bigint, total_qty bigint, avg_qty double, cancel_ratio double, orders_per_second double")
    assert sinks.score_stream(broken, 0.0).count() == 0


def test_counts_add_up_and_a_lost_row_fails(spark, events, parts, tmp_path):
    source = str(tmp_path / "in")
    for k, p in enumerate(parts):
        p.write.parquet(f"{source}/part{k}")
    rejected = book.replay(events, "trace").filter("skipped").count()
    for name, spoil in (("whole", lambda df: df), ("lost", lambda df: df.filter("seq != 7"))):
        listener = sinks.Completeness()
        spark.streams.addListener(listener)
        try:
            trace = sinks.accounted(spoil(sinks.book_stream(sinks.counted(reader(spark, events, source)))))
            query = trace.writeStream.format("noop").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            query.awaitTermination()
            for _ in range(50):  # the listener hears of the last micro-batch a little later
                if listener.totals().get("read.n") == events.count():
                    break
                time.sleep(0.2)
            if name == "whole":
                assert listener.check(events.count()) == {"published": events.count(), "read": events.count(), "processed": events.count() - rejected, "rejected": rejected} and rejected
                with pytest.raises(RuntimeError):
                    listener.check(events.count() + 1)
            else:
                with pytest.raises(RuntimeError):
                    listener.check(events.count())
        finally:
            spark.streams.removeListener(listener)
