"""Lookups by account through postings: the same alerts as a scan, from the named files only."""

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import account_index as index
from tapewatch.operators import alerts as store

ALERT = "alert_id bigint, account_ids array<string>, window_start_ns bigint, evidence string"


def some(spark, first, n):
    """Every third alert is of one account; each has one to three accounts, some named twice or null, some none."""
    rows = []
    for i in range(first, first + n):
        own = ["HOT"] if i % 3 == 0 else []
        rows.append((i, [*own, f"ACC-{i % 17}", f"ACC-{i % 5}"] if i % 11 else None if i % 2 else [], 1000 * i, f"seen {i}"))
    rows.append((first + n, ["ACC-1", "ACC-1", None], 5, "twice"))
    return spark.createDataFrame(rows, ALERT)


@pytest.fixture
def built(spark, tmp_path):
    folder, batches = str(tmp_path / "index"), [some(spark, 1000 * b, 300) for b in range(3)]
    for b, df in enumerate(batches):
        index.add_batch(df, folder, b, ranges=8, file_rows=40)
    return folder, batches[0].union(batches[1]).union(batches[2])


def ids(df):
    return sorted(r.alert_id for r in df.collect())


def test_lookups_equal_a_scan(spark, built):
    folder, every = built
    for account in ("HOT", "ACC-1", "ACC-16", "ACC-404", ""):
        assert ids(index.account_alerts(spark, folder, every.schema, account)) == ids(store.find_alerts(every, account=account)), account
        some_time = {"start_ns": 50_000, "end_ns": 1_100_000}
        assert ids(index.account_alerts(spark, folder, every.schema, account, **some_time)) == ids(store.find_alerts(every, account=account, **some_time))


def test_a_hot_account_is_read_by_batches(spark, built):
    folder, every = built
    assert ids(index.account_alerts(spark, folder, every.schema, "HOT", named_files=2)) == ids(store.find_alerts(every, account="HOT"))


def test_only_named_files_and_one_part_are_read(spark, built):
    folder, every = built
    found = index.account_alerts(spark, folder, every.schema, "ACC-16")
    named = {(r.batch, r.file) for r in index.postings(spark, folder, "ACC-16").collect()}
    assert {tuple(f.rsplit("/", 2)[1:]) for f in found.inputFiles()} == {(f"batch={b}", f) for b, f in named}
    assert 0 < len(named) <= len(spark.read.parquet(f"{folder}/alerts").inputFiles()) / 2
    parts = {f.split("part=")[1].split("/")[0] for f in index.postings(spark, folder, "ACC-16").inputFiles()}
    assert len(parts) == 1


def test_postings_are_one_row_for_an_account_and_file(spark, built):
    folder, every = built
    got = {(r.account, r.n_alerts, r.first_ns, r.last_ns) for r in index.account_totals(spark, folder).collect()}
    flat = every.select("alert_id", "window_start_ns", F.explode(F.array_distinct("account_ids")).alias("account")).filter("account IS NOT NULL")
    assert got == {tuple(r) for r in flat.groupBy("account").agg(F.count("*"), F.min("window_start_ns"), F.max("window_start_ns")).collect()}
    assert index.postings(spark, folder).groupBy("account", "batch", "file").count().filter("count > 1").count() == 0


def test_a_batch_that_runs_again_replaces_its_own(spark, built):
    folder, every = built
    index.index_sink(folder)(some(spark, 1000, 40), 1)
    now = some(spark, 0, 300).union(some(spark, 1000, 40)).union(some(spark, 2000, 300))
    for account in ("HOT", "ACC-1", "ACC-16"):
        assert ids(index.account_alerts(spark, folder, every.schema, account)) == ids(store.find_alerts(now, account=account))


def test_a_batch_without_postings_is_not_seen_and_empty_ones_do_no_harm(spark, tmp_path):
    folder, df = str(tmp_path / "index"), some(spark, 0, 20)
    assert ids(index.account_alerts(spark, folder, df.schema, "HOT")) == [] and index.account_totals(spark, folder).count() == 0
    index.add_batch(df.limit(0), folder, 0)
    assert ids(index.account_alerts(spark, folder, df.schema, "HOT")) == []
    df.write.parquet(f"{folder}/alerts/batch=1")  # ended before its postings
    assert ids(index.account_alerts(spark, folder, df.schema, "HOT")) == []
    index.add_batch(df, folder, 1)
    assert ids(index.account_alerts(spark, folder, df.schema, "HOT")) == ids(store.find_alerts(df, account="HOT"))
