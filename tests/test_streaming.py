"""Streams give what the batch operators give."""

from tapewatch.functions.storage import keep
from tapewatch.operators import anomaly, book, detectors, keyed
from tapewatch.plans import surveillance
from tapewatch.sources import adapter
from tapewatch.streaming import live


def test_streams_equal_batch(spark, sf, tmp_path):
    events = keep(surveillance.sequenced(spark, sf))
    source, ents = str(tmp_path / "events"), keep(adapter.entities(spark, sf))
    for k in range(3):  # files whose seq ranges follow one another
        events.filter(f"seq % 3 >= 0 and floor((seq - 1) * 3 / {events.count()}) = {k}").coalesce(1).write.mode("append").parquet(f"{source}/part{k}")
    for name, stream, batch, keys in (
        ("spoof", live.spoof_stream, book.replay(events, "scores"), ["seq", "score", "evidence"]),
        ("front", lambda e: live.front_running_stream(e, ents), keyed.front_running_pairs(events, ents), ["seq", "prior_order", "order_id"]),
        ("stats", live.outlier_stream, keyed.outliers(events), ["seq", "order_id", "z", "n"]),
        ("flow", live.feature_stream, anomaly.flow_features(events), ["account_id", "seq", "order_count", "total_qty"]),
    ):
        got, seen = [], []
        reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(source)
        live.drain(stream(reader), [lambda df, n, got=got: got.extend(df.select(*keys).collect()), lambda df, n, seen=seen: seen.append(n)], str(tmp_path / name))
        assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select(*keys).collect())) and len(seen) >= 3


def test_wash_stream_equals_batch(spark, sf, tmp_path):
    events, ents = keep(surveillance.sequenced(spark, sf)), keep(adapter.entities(spark, sf))
    events.write.parquet(str(tmp_path / "e"))
    got = []
    live.drain(live.wash_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), ents), [lambda df, n: got.extend(r.trade_id for r in df.collect())], str(tmp_path / "c"))
    want = [r.order_ids[1] for r in detectors.wash_trades(events.filter("kind = 'execution'"), ents).collect()]
    assert sorted(got) == sorted(want) and got
    volumes = live.volumes_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = volumes.writeStream.format("memory").queryName("volumes").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "v")).start()
    q.awaitTermination()
    assert spark.table("volumes").agg({"volume": "sum"}).first()[0] == events.filter("kind = 'execution'").agg({"qty": "sum"}).first()[0]


def test_closing_sink_equals_batch(spark, sf, tmp_path):
    events, ents, close = keep(surveillance.sequenced(spark, sf)), keep(adapter.entities(spark, sf)), keep(surveillance.session_close(spark, sf))
    inside = keep(events.filter("kind = 'execution'").join(close, "instrument_id").filter("timestamp_ns between session_close_ns - 300000000000 and session_close_ns").drop("session_close_ns"))
    low, high = inside.agg({"seq": "min"}).first()[0], inside.agg({"seq": "max"}).first()[0]
    sink = live.closing_sink(ents, close, str(tmp_path))
    cuts = [0, low + (high - low) // 3, low + 2 * (high - low) // 3, events.count()]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = events.filter(f"seq > {a} and seq <= {b}")
        for _ in range(1 + (k == 1)):  # a micro-batch that runs again changes nothing
            sink(part, k)
    got = spark.read.parquet(str(tmp_path / "alerts"))
    want = detectors.marking_the_close(events.filter("kind = 'execution'"), ents, close)
    cols = ["instrument_id", "score", "account_ids", "order_ids", "evidence", "idx"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert got.count() and got.select("batch").distinct().count() > 1
