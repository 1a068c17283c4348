"""The detectors on streams: the same state machines as in batch, keyed and kept by Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tapewatch.functions.schemas import require_unlabelled
from tapewatch.functions.storage import ship_package
from tapewatch.operators import detectors
from tapewatch.operators.anomaly import FEATURE_ROWS, FlowWindow
from tapewatch.operators.book import IN, SCORES, Book, SpoofState
from tapewatch.operators.keyed import OUTLIERS, PAIRS, FrontRunState, RunningStats, front_run_step, stats_step, with_relations
from tapewatch.operators.relations import is_related


class _Keyed(StatefulProcessor):
    """Keeps one pickled state object for each key and feeds it the key's rows in seq order.

    Rows of a micro-batch are sorted by seq; across batches the source must give rising offsets.
    """

    def fresh(self):
        raise NotImplementedError

    def step(self, state, key: tuple, row: dict) -> dict | list[dict] | None:
        raise NotImplementedError

    names: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = pickle.loads(bytes(self._state.get()[0])) if self._state.exists() else self.fresh()
        frame = pd.concat(list(rows)).sort_values("seq")
        out = []
        for row in frame.to_dict("records"):
            got = self.step(state, key, row)
            if got:
                out += got if isinstance(got, list) else [got]
        self._state.update((pickle.dumps(state),))
        if out:
            yield pd.DataFrame(out)[self.names]

    def close(self) -> None:
        pass


class SpoofProcessor(_Keyed):
    names = [f.split()[0] for f in SCORES.split(", ")]

    def fresh(self):
        return Book(), SpoofState()

    def step(self, state, key, row):
        book, spoof = state
        row = {**row, "instrument_id": key[0]}
        try:
            book.apply(row)
        except ValueError:
            return None
        got = spoof.process(book, row)
        return got and {"instrument_id": key[0], "seq": row["seq"], "book_snapshot_sequence": book.sequence, **got}


class FlowProcessor(_Keyed):
    names = [f.split()[0] for f in FEATURE_ROWS.split(", ")]

    def fresh(self):
        return FlowWindow()

    def step(self, state, key, row):
        got = state.add(row["status"], int(row["qty"]), int(row["timestamp_ns"]))
        return got and {"account_id": key[0], "instrument_id": key[1], "seq": row["seq"], "timestamp_ns": row["timestamp_ns"], **got}


class FrontRunProcessor(_Keyed):
    names = [f.split()[0] for f in PAIRS.split(", ")]

    def fresh(self):
        return FrontRunState()

    def step(self, state, key, row):
        rel = row["rel"]
        return front_run_step(state, {**row, "rel": [] if rel is None else list(rel), "instrument_id": key[0], "side": key[1]})


class StatsProcessor(_Keyed):
    names = [f.split()[0] for f in OUTLIERS.split(", ")]

    def fresh(self):
        return RunningStats()

    def step(self, state, key, row):
        return stats_step(state, {**row, "account_id": key[0], "instrument_id": key[1]})


def front_running_stream(events: DataFrame, entities: DataFrame) -> DataFrame:
    ship_package(events.sparkSession)
    rows = with_relations(events, entities)
    return rows.groupBy("instrument_id", "side").transformWithStateInPandas(FrontRunProcessor(), PAIRS, "Append", "None")


def outlier_stream(events: DataFrame) -> DataFrame:
    ship_package(events.sparkSession)
    rows = require_unlabelled(events).filter("status = 'New'").select("account_id", "instrument_id", "seq", "order_id", "qty", "timestamp_ns")
    return rows.groupBy("account_id", "instrument_id").transformWithStateInPandas(StatsProcessor(), OUTLIERS, "Append", "None")


def spoof_stream(events: DataFrame) -> DataFrame:
    """Scored cancels of a stream (or a table) of events with seq; state is kept for each instrument."""
    ship_package(events.sparkSession)
    rows = require_unlabelled(events).select(*IN)
    return rows.groupBy("instrument_id").transformWithStateInPandas(SpoofProcessor(), SCORES, "Append", "None")


def feature_stream(events: DataFrame) -> DataFrame:
    ship_package(events.sparkSession)
    rows = require_unlabelled(events).filter("kind = 'order'").select("account_id", "instrument_id", "seq", "status", "qty", "timestamp_ns")
    return rows.groupBy("account_id", "instrument_id").transformWithStateInPandas(FlowProcessor(), FEATURE_ROWS, "Append", "None")


def wash_stream(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Executions between related accounts: two joins of the stream with the account table, no state."""
    side = lambda p: entities.select(F.col("account_id").alias(f"_{p}"), F.col("owner_id").alias(f"_{p}_owner"), F.col("linked_account_ids").alias(f"_{p}_links"))
    rows = require_unlabelled(events).filter("kind = 'execution' and coalesce(counterparty_account_id, '') != ''")
    rows = rows.join(side("a"), F.col("account_id") == F.col("_a"), "left").join(side("b"), F.col("counterparty_account_id") == F.col("_b"), "left")
    hit = rows.filter(is_related(F.col("account_id"), F.col("counterparty_account_id"), F.col("_a_owner"), F.col("_b_owner"), F.col("_a_links"), F.col("_b_links")))
    return hit.select("seq", "trade_id", "order_id", "instrument_id", "account_id", "counterparty_account_id", "timestamp_ns")


def volumes_stream(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Executed volume of each instrument in windows of event time; rows later than late are left out."""
    rows = events.filter("kind = 'execution'").withColumn("event_time", F.timestamp_micros(F.expr("timestamp_ns div 1000")))
    return rows.withWatermark("event_time", late).groupBy(F.window("event_time", window), "instrument_id").agg(F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_trades"))


def closing_sink(entities: DataFrame, close: DataFrame, folder: str, window_ns: int = 300_000_000_000) -> Callable[[DataFrame, int], None]:
    """A sink for drain that writes alerts of marking the close to folder/alerts.

    The executions of the closing windows (the last minutes of a session) are kept in folder by
    micro-batch, and those so far are checked again with each one. A group's first check never
    changes later, so an alert is new if the execution that fired it came in this micro-batch; and one that
    runs again overwrites its own rows. Time may not go back from one micro-batch to the next.
    """
    ends = close.select(F.col("instrument_id").alias("_i"), "session_close_ns")
    inside = (F.col("instrument_id") == F.col("_i")) & F.col("timestamp_ns").between(F.col("session_close_ns") - window_ns, F.col("session_close_ns"))

    def sink(batch: DataFrame, number: int) -> None:
        rows = require_unlabelled(batch).filter("kind = 'execution'").join(ends, inside, "left_semi")
        rows.write.mode("overwrite").parquet(f"{folder}/executions/batch={number}")
        kept = batch.sparkSession.read.parquet(f"{folder}/executions")
        found = detectors.marking_the_close(kept.filter(F.col("batch") <= number).drop("batch"), entities, close, window_ns)
        fired = kept.filter(F.col("batch") == number).select("instrument_id", *detectors.ORDER_COLS)
        found.join(fired, fired.columns, "left_semi").write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")

    return sink


def drain(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Run a stream over all that its source has now, giving each micro-batch to every sink, then stop."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for sink in sinks:
            sink(kept, number)
        kept.unpersist()

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
