"""Ranked search against a plain-Python version that scores every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewatch.llm import queries, ranked_search
from tests.llm.cases import TEXTS, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_all, l_all = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        found = []
        for doc_id, c in counts:
            m = 50 + (50 * sum(c.values()) * n_all) // max(l_all, 1)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, n + 1, i if known else None, -s) for n, (s, known, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, sf):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    assert got(queries.op12_ranked_search(spark, sf)) == brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


@pytest.mark.parametrize("shard_bytes,block_bytes,parts", [(1, 500, 1), (2000, 1 << 22, 3)])
def test_odd_texts_ties_and_any_sharding(spark, shard_bytes, block_bytes, parts):
    twins = [(100 + i, "Alpha beta, gamma", "en", "a") for i in range(120)] + [(50, "alpha BETA gamma", "en", "a"), (50, "alpha BETA gamma", "en", "a"), (None, "alpha beta gamma", "en", "a")]
    rows = [*TEXTS, *twins]
    items = [(1, "beta? ALPHA! beta"), (2, None), (3, ""), (None, "the fox ÜNÏCÖDÉ Ünïcödé 漢字"), (4, "w1x1 w5x5"), (5, "nowhere"), (1, "gamma"), (6, "a b c d e f g h \x00x")]
    index = ranked_search.build_index(documents(spark, rows).repartition(parts), shard_bytes=shard_bytes)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("clash"))
    assert got(ranked_search.search(index, asked, block_bytes=block_bytes)) == brute([r[:2] for r in rows], items)
    assert got(ranked_search.search(index, asked, k=3)) == brute([r[:2] for r in rows], items, 3)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    index = ranked_search.build_index(documents(spark, []))
    assert index.count() == 0
    assert got(ranked_search.search(index, none)) == [] and got(ranked_search.search(index, spark.createDataFrame([(1, "a")], none.schema))) == []
    assert got(ranked_search.search(ranked_search.build_index(documents(spark)), none)) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 12))
def test_best_is_tie_safe(scores, k):
    want = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:k]
    assert ranked_search.best(np.array(scores, np.int64), k).tolist() == [i for _, i in want]


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Ab1 " * 50 + "z" * 300 + "-é" * 40
    for cut in (1, 7, 100):
        monkeypatch.setattr(ranked_search, "CUT_BYTES", cut)
        assert [t.decode() for part in ranked_search.term_lists(text) for t in part] == terms(text)
