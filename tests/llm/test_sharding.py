"""Rendezvous shards against plain Python, their shares, growth, slots and files."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapewatch.llm import queries, sharding
from tests.llm.cases import TEXTS, documents, uncoalesced


def brute_shard(doc_id, weights):
    def wait(s):
        text = f"shard|{'' if doc_id is None else doc_id}|{s}"
        return -math.log((int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 16**12) / weights[s]

    return min((wait(s), s) for s in range(len(weights)) if weights[s] > 0)[1]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op11_sharding(spark, sf).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    for r in rows:
        assert r.law == "key" and r.shard == brute_shard(r.doc_id, [1.0] * 16) and r.grown_shard == brute_shard(r.doc_id, [1.0] * 17)
    for s in range(16):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and [r.doc_id for r in own] == sorted(r.doc_id for r in own)


def test_shares_follow_weights_and_few_rows_move(spark):
    docs, weights = spark.range(40_000).withColumnRenamed("id", "doc_id"), (1.0, 2.0, 0.0, 5.0)
    rows = sharding.assign(docs, weights=weights, grown_by=2.0).select("shard", "grown_shard").collect()
    n = Counter(r.shard for r in rows)
    assert set(n) == {0, 1, 3} and all(abs(n[s] - 40_000 * weights[s] / 8) < 500 for s in n)
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {4} and abs(len(moved) - 40_000 * 2 / 10) < 500
    fewer = sharding.assign(docs, weights=(1.0, 2.0, 0.0, 0.0)).select("shard").collect()
    assert all(a.shard == b.shard for a, b in zip(rows, fewer) if a.shard != 3)  # without a shard, only its own rows move
    for bad in ((0.0,), (-1.0, 2.0), ()):
        with pytest.raises(ValueError):
            sharding.assign(docs, weights=bad)


def test_a_hot_key_is_spread_and_numbered(spark):
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    with uncoalesced(spark):
        rows = sharding.place(docs).withColumn("part", F.spark_partition_id()).collect()
    hot = Counter(r.part for r in rows if r.doc_id == 7)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1 and len(hot) > 1 and max(hot.values()) < 9_000
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_cases(spark):
    docs = documents(spark).withColumns({"shard": F.lit("own"), "row": F.lit(1), "key": F.lit("k"), "n": F.lit(0), "won": F.lit(None).cast("string")})
    out = sharding.place(docs, weights=(1.0, 1.0))
    assert out.columns == [*docs.columns, "shard_", "slot", "grown_shard"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, *_ in TEXTS)
    assert {r["shard_"] for r in rows if r.doc_id is None} == {brute_shard(None, [1.0, 1.0])}
    assert sharding.place(documents(spark, [])).count() == 0


def test_files(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text")
    sharding.write_shards(sharding.place(docs, weights=(1.0, 3.0)), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t) for i, t, *_ in TEXTS)
    assert all(r.shard == brute_shard(r.doc_id, [1.0, 3.0]) for r in back)
