"""Poisson replication against plain Python."""

import hashlib
import math
from collections import Counter

from tapewatch.llm import mixing, queries
from tests.llm.cases import TEXTS, documents


def brute_count(doc_id, source, rate, seed="mix"):
    text = "|".join([seed, "" if doc_id is None else str(doc_id), source or ""])
    u = int(hashlib.md5(text.encode()).hexdigest()[: mixing.DIGITS], 16) / 16**mixing.DIGITS
    k, p = 0, math.exp(-rate)
    cdf = p
    while cdf <= u and k < 500:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_op4_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes = Counter(d.source for d in docs)
    whole = sum(n**0.5 for n in sizes.values())
    want = {d.doc_id: brute_count(d.doc_id, d.source, len(docs) * sizes[d.source] ** 0.5 / whole / sizes[d.source]) for d in docs}
    rows = queries.op4_mixing(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == {k: v for k, v in want.items() if v}
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert {(r.doc_id, r.copy_no) for r in rows} == {(k, i + 1) for k, v in want.items() for i in range(v)}


def test_targets_are_met_on_average(spark):
    rows = [(i, "x", "en", "big" if i % 10 else "small") for i in range(20_000)]
    out = Counter(r.source for r in mixing.poisson_mix(documents(spark, rows), targets={"big": 1, "small": 3}, total=0.5).select("source").collect())
    assert abs(out["small"] - 7500) < 400 and abs(out["big"] - 2500) < 250


def test_cases(spark):
    docs = documents(spark)
    out = mixing.poisson_mix(docs, total=3.0)
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key", "rate"]
    sizes = Counter(s or "" for *_, s in TEXTS)
    whole = sum(n**0.5 for n in sizes.values())
    rate = {s: 3 * len(TEXTS) * sizes[s] ** 0.5 / whole / sizes[s] for s in sizes}
    assert out.count() == sum(brute_count(i, s or "", rate[s or ""]) for i, _, _, s in TEXTS)
    assert mixing.poisson_mix(documents(spark, [])).count() == 0
    assert mixing.poisson_mix(docs, targets={"nobody": 1.0}).count() == 0


def test_large_rates(spark):
    """A rate of 2000 beside small ones, against exact fractions of the masses around the mode."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    rows = [(i, "x", "en", "rare" if i < 3 else "big") for i in range(3000)]
    got = Counter(r.doc_id for r in mixing.poisson_mix(documents(spark, rows), targets={"rare": 2.0, "big": 1.0}, total=3.0).collect())
    for i in range(3000):
        rate = 2000 if i < 3 else Decimal(3000) / 2997
        text = f"mix|{i}|{'rare' if i < 3 else 'big'}"
        u = Decimal(int(hashlib.md5(text.encode()).hexdigest()[: mixing.DIGITS], 16)) / 16**mixing.DIGITS
        k, p = 0, (-Decimal(rate)).exp()
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / Decimal(k)
            cdf += p
        assert got[i] == k, i


def test_no_column_name_clashes(spark):
    docs = documents(spark).selectExpr("*", *(f"'mine' as `{c}`" for c in ("_source", "_u", "_copy", "_count", "_rate", "_order", "row", "u", "order", "copy", "count", "_cdf", "rate", "a.b")))
    out = mixing.poisson_mix(docs, total=3.0)
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
    rows = out.collect()
    assert rows and all(r[c] == "mine" for r in rows for c in ("_source", "_u", "_rate", "_order", "order", "rate", "a.b"))
