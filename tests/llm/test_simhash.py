"""SimHash against a brute-force version."""

import re

import xxhash

from tapewatch.llm import queries, rules, simhash
from tapewatch.operators import components
from tests.llm.cases import TEXTS, documents

UP = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(UP.get(c, c) for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def compare(rows, docs):
    ids, texts = zip(*docs)
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_components(fps)
    least = {r: min((i for i, q in zip(ids, roots) if q == r and i is not None), default=None) for r in set(roots)}
    want = sorted((str(i), f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, roots))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == want


def test_cases(spark):
    compare(simhash.near_duplicates(documents(spark)).collect(), [t[:2] for t in TEXTS])
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_op2_query(spark, sf):
    compare(queries.op2_simhash(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_every_plan_finds_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 1, 2, 3, 4, 5)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = sorted(fps, key=signed)
    roots = brute_components(fps)
    least = {r: min(signed(f) for f, q in zip(fps, roots) if q == r) for r in set(roots)}
    want = {signed(f): least[r] for f, r in zip(fps, roots) if roots.count(r) > 1}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    for n in (2, 10**4, 10**7, 10**9):
        plan = simhash.segment_plan(n)
        assert sum(r + 1 for _, _, r in plan) == 5 and sum(w for _, w, _ in plan) == 64
        assert {r.node: r.label for r in simhash.fingerprint_labels(df, n).collect()} == want


def test_a_large_class_gives_links_in_proportion(spark, monkeypatch):
    """2,000 fingerprints around one point and 60 around another that is linked to it by a chain of two."""
    import random

    rng, seen = random.Random(4), []
    near = lambda c, d: c ^ sum(1 << k for k in rng.sample(range(62), d))
    fps = {near(0, rng.randint(0, 3)) for _ in range(2000)} | {near(0b1111111, rng.randint(0, 1)) for _ in range(60)} | {near(0x3F0F0F0F0F0F0F0F, 1) for _ in range(40)}
    real = simhash.component_labels
    monkeypatch.setattr(simhash, "component_labels", lambda pairs: seen.append(pairs.count()) or real(pairs))
    got = {r.node: r.label for r in simhash.fingerprint_labels(spark.createDataFrame([(f,) for f in fps], "fp bigint"), len(fps)).collect()}
    roots = brute_components(sorted(fps))
    least = {}
    for f, r in zip(sorted(fps), roots):
        least.setdefault(r, f)
    assert got == {f: least[r] for f, r in zip(sorted(fps), roots) if roots.count(r) > 1}
    assert max(seen) < simhash.HOT * len(fps)  # buckets of up to HOT entries are compared whole


def test_no_column_name_clashes(spark):
    docs = documents(spark).selectExpr("*", *(f"'mine' as `{c}`" for c in ("_row", "row", "_rule_key", "key", "_id", "rows", "_text", "a.b")))
    for left in (simhash.first_of_each_class(docs), rules.filter_documents(docs)):
        assert left.columns == docs.columns
        assert all(r["_row"] == r["_rule_key"] == r["key"] == r["a.b"] == "mine" for r in left.collect())


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.component_labels(pairs).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_unrelated_texts_with_one_id_both_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i * 7}" for i in range(60))
    rows = [(1, a, "en", "x"), (1, b, "en", "x"), (1, a, "de", "x"), (2, a, "en", "x"), (3, b, "en", "x"), (4, "a third text of its own", "en", "x")]
    left = simhash.first_of_each_class(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in left) == sorted([(1, a, "de"), (1, b, "en"), (4, "a third text of its own", "en")])
