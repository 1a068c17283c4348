"""What streams write and what can be read while they run: alerts with gapless ids, live books, and counts that must add up."""

from __future__ import annotations

import json
import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tapewatch.functions.schemas import require_unlabelled
from tapewatch.functions.storage import keep, numbered, ship_package
from tapewatch.operators import anomaly, reports
from tapewatch.operators.book import IN, SNAPSHOTS, TRACE, Book
from tapewatch.sources.files import with_event_time
from tapewatch.streaming.live import _Keyed, feature_stream

#: Events of each instrument that a running query keeps to be shown.
RECENT = 200
LOG = "first bigint, count bigint, batch bigint"
RECENT_ROWS = "instrument_id string, recency int, seq bigint, kind string, status string, order_id string, side string, price double, qty bigint, timestamp_ns bigint"


class BookProcessor(_Keyed):
    """A book and its last events for each instrument; a row of book.TRACE for every event, rejected or not."""

    names = [f.split()[0] for f in TRACE.split(", ")]

    def fresh(self):
        return Book(), deque(maxlen=RECENT)

    def step(self, state, key, row):
        book, recent = state
        row = {**row, "instrument_id": key[0], "qty": int(row["qty"]), "seq": int(row["seq"]), "timestamp_ns": int(row["timestamp_ns"])}
        skipped = False
        try:
            book.apply(row)
        except ValueError:
            skipped = True
        else:
            recent.append({c: row[c] for c in ("seq", "kind", "status", "order_id", "side", "price", "qty", "timestamp_ns")})
        return {"instrument_id": key[0], "seq": row["seq"], "sequence": book.sequence, "skipped": skipped, "best_bid": book.best("Buy"), "best_ask": book.best("Sell"), "level_qty": book.level_qty(row["side"], row["price"]), "timestamp_ns": row["timestamp_ns"]}


def book_stream(events: DataFrame) -> DataFrame:
    """The trace of a stream's books; while the query runs, live_depth and live_recent read its state."""
    ship_package(events.sparkSession)
    return require_unlabelled(events).select(*IN).groupBy("instrument_id").transformWithStateInPandas(BookProcessor(), TRACE, "Append", "None")


def live_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """instrument_id and data: the state that a book_stream has committed with its last micro-batch, whether it still runs or not."""
    state = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    return state.select(F.col("key.instrument_id").alias("instrument_id"), F.col("value.data").alias("data"))


def live_depth(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The books as they stand, with levels from the best price and orders by priority, read from a running query's state."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            texts = [json.dumps(pickle.loads(data)[0].snapshot(name)) for name, data in zip(names, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["instrument_id", "snapshot"])

    ship_package(spark)
    return reports.depth_json(live_state(spark, checkpoint).mapInArrow(show, SNAPSHOTS))


def live_recent(spark: SparkSession, checkpoint: str, limit: int = RECENT) -> DataFrame:
    """The last accepted events of each instrument, recency 1 being the newest, read from a running query's state."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in RECENT_ROWS.split(", "))])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                last = list(pickle.loads(data)[1])[::-1][:limit]
                yield pa.RecordBatch.from_pylist([{"instrument_id": name, "recency": n + 1, **e} for n, e in enumerate(last)], schema)

    ship_package(spark)
    return live_state(spark, checkpoint).mapInArrow(show, RECENT_ROWS)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The log of an alert sink: batch, its first id and how many it has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{folder}/log")


def alert_sink(folder: str, order: list) -> Callable[[DataFrame, int], None]:
    """A sink for drain that stores alerts in folder with ids from 1 on and without gaps, in the given order within a micro-batch.

    A micro-batch first writes its rows to a folder of its own, then its range of ids to the log, which makes it
    visible. One that failed before that starts at the same id again and overwrites its rows; one that is in the log and
    comes again (the stream failed just after) is left as it is.
    """
    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = committed(spark, folder).filter(F.col("batch") <= number)
        done, last = log.agg(F.max("batch"), F.coalesce(F.max(F.col("first") + F.col("count")), F.lit(1))).first()
        if done == number:
            return
        rows = keep(numbered(batch, order, "alert_id", last))
        with_event_time(rows, "window_end_ns").write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
        spark.createDataFrame([(last, rows.count())], "first bigint, count bigint").coalesce(1).write.mode("overwrite").json(f"{folder}/log/batch={number}")

    return sink


def stored_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts of all micro-batches in the log."""
    return spark.read.parquet(f"{folder}/alerts").join(F.broadcast(committed(spark, folder).select("batch")), "batch", "left_semi")


def score_stream(features: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Anomaly alerts of a stream (or table) of flow windows. Windows that can't be scored (a feature isn't finite) pass without an alert."""
    ship_package(features.sparkSession)
    usable = F.lit(True)
    for c in anomaly.FEATURES:
        usable = usable & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return anomaly.anomaly_alerts(anomaly.score_features(features.filter(usable)), threshold)


def scoring_chain(events: DataFrame, folder: str, threshold: float, drain: Callable) -> None:
    """Two streaming queries over all that is there now, each with its own checkpoint: events to flow windows in files, and these to stored alerts.

    The file sink takes each micro-batch once, so the second query may fail, stay behind or start anew without the first.
    """
    windows = feature_stream(events).writeStream.format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/first").trigger(availableNow=True).start()
    windows.awaitTermination()
    found = events.sparkSession.readStream.schema(anomaly.FEATURE_ROWS).parquet(f"{folder}/windows")
    drain(score_stream(found, threshold), [alert_sink(f"{folder}/store", ["window_end_ns", "seq", "instrument_id"])], f"{folder}/second")


class Completeness(StreamingQueryListener):
    """Sums what queries observed: rows read (counted), and rows that came out, rejected ones among them (accounted).

    A micro-batch that runs again counts once, as its numbers are kept by query and batch.
    """

    def __init__(self) -> None:
        self.seen: dict[tuple, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for name, row in p.observedMetrics.items():
            for key, value in row.asDict().items():
                self.seen.setdefault((str(p.id), p.batchId), {})[f"{name}.{key}"] = value or 0

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for row in list(self.seen.values()):
            for k, v in row.items():
                out[k] = out.get(k, 0) + v
        return out

    def check(self, published: int) -> dict[str, int]:
        """read, processed and rejected; RuntimeError unless all published events were read, and each came out as one of the two."""
        t = self.totals()
        read, processed, rejected = t.get("read.n", 0), t.get("done.processed", 0), t.get("done.rejected", 0)
        if read != published or processed + rejected != read:
            raise RuntimeError(f"published {published} events, read {read}, processed {processed}, rejected {rejected}")
        return {"published": published, "read": read, "processed": processed, "rejected": rejected}


def counted(events: DataFrame) -> DataFrame:
    return events.observe("read", F.count(F.lit(1)).alias("n"))


def accounted(trace: DataFrame) -> DataFrame:
    return trace.observe("done", F.count_if(~F.col("skipped")).alias("processed"), F.count_if(F.col("skipped")).alias("rejected"))
