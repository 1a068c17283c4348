"""Quality rules and chat formatting against plain Python."""

import hashlib
import math
import re
from collections import Counter

from tapewatch.llm import chat, queries, rules
from tests.llm.cases import TEXTS, documents

WORD = "[^\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def measured(rows):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def brute_kept(docs):
    """Verdicts of (lang, source, text) documents, by sorted lists instead of sketches."""
    measures = []
    for lang, source, t in docs:
        n, chars, symbols, dup, _, failed = brute(t)
        lines = sum(re.search(WORD, x) is not None for x in (t or "").split("\n"))
        counts = [(symbols, chars, 10**6), (dup, lines, 10**6), (chars, n, 1000)]
        measures.append((lang or "", source or "", counts, failed))

    def low_end(v):
        drop = max(v.bit_length() - rules.DIGITS, 0)
        return v >> drop << drop

    def limits(which):
        out = []
        for j in range(3):
            v = sorted(low_end(c[j][0] * c[j][2] // max(c[j][1], 1)) for g0, g1, c, failed in measures if not failed and which(g0, g1))
            if not v:
                return 0, None
            q1, q3 = (v[math.ceil(len(v) * r / 4) - 1] for r in (1, 3))
            ends = []
            for fence, tail in ((q3 + rules.FENCE * (q3 - q1), v), (q1 - rules.FENCE * (q3 - q1), v[::-1])):
                tail = [x for x in tail if (x > fence if not ends else x < fence)]
                ends.append(fence + (tail[math.ceil(len(tail) / rules.TAILTH) - 1] - fence) * rules.REACH if tail else fence)
            out.append(tuple(ends))
        return len(v), out

    def drawn(own, wider):
        n, mine = own
        return [tuple((n * a + rules.PRIOR_ROWS * b) / (n + rules.PRIOR_ROWS) for a, b in zip(x, y)) for x, y in zip(mine, wider)] if mine else None

    every = limits(lambda *_: True)[1]
    langs = {x: drawn(limits(lambda a, _: a == x), every) for x in {m[0] for m in measures}}  # noqa: B023
    groups = {x: drawn(limits(lambda a, b: (a, b) == x), langs[x[0]]) for x in {m[:2] for m in measures}}  # noqa: B023
    out = []
    for g0, g1, counts, failed in measures:
        ok = not failed
        for j, (count, per, unit) in enumerate(counts):
            if ok:
                high, low = (max(x, 0) * per / unit for x in groups[g0, g1][j])
                ok = count <= high + rules.SIGMAS * math.sqrt(high + 1) and (j < 2 or count >= low - rules.SIGMAS * math.sqrt(low + 1))
        out.append(ok)
    return out


def test_kept_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = {r.doc_id: r.kept for r in queries.op7_rules(spark, sf).collect()}
    assert [kept[d.doc_id] for d in docs] == brute_kept([(d.lang, d.source, d.text) for d in docs])
    rows = [(lang, source, t) for _, t, lang, source in TEXTS]
    got = rules.quality_rules(documents(spark)).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(i), k) for (i, *_), k in zip(TEXTS, brute_kept(rows)))


def test_limits_differ_between_groups_and_bad_documents_go(spark):
    """Measured on whole sf0.01: labelled good documents stay, seven of eight bad ones that pass the base rules go (groups have about eleven rows)."""
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in queries.op7_rules(spark, path).collect() if not r.base_failed]
    good, bad = ([r.kept for r in rows if labels.get(r.doc_id) == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.125 * len(bad)
    limits = rules.adaptive_limits(rules.text_measures(docs)).collect()
    assert len({r._limit for r in limits}) > 0.9 * len(limits)


def test_rules_cases(spark):
    rows = rules.quality_rules(documents(spark)).collect()
    assert measured(rows) == sorted((str(i), *brute(t)) for i, t, *_ in TEXTS)
    assert not any(r.kept and r.base_failed for r in rows)
    assert rules.quality_rules(documents(spark, [])).count() == 0


def test_op7_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op7_rules(spark, sf).collect()
    assert measured(rows) == sorted((str(r.doc_id), *brute(r.text)) for r in docs)
    kept = {r.doc_id: r.kept for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    long = [d.doc_id for d in docs if labels.get(d.doc_id) == 1 and not brute(d.text)[-1]]
    assert sum(kept[i] for i in long) >= 0.98 * len(long)


def test_limits_are_a_groups_own_quantiles(spark):
    rows = [(i, " ".join(f"word{i}a{j}" for j in range(30)), "en", "clean") for i in range(150)]
    rows += [(1000 + i, " ".join(f"w#{i}##{j}" for j in range(30)), "en", "hashes") for i in range(150)]
    rows.append((5000, " ".join(f"w#{j}##" for j in range(30)), "en", "clean"))
    kept = {r.doc_id: r.kept for r in rules.quality_rules(documents(spark, rows)).collect()}
    assert not kept[5000] and all(kept[i] for i in kept if i != 5000)


def test_limits_on_symbols_are_a_groups_own(spark):
    """One rate of symbols is usual in one group and far out in another; long texts with few symbols stay."""
    text = lambda i, n, symbols: " ".join(f"{'#' if j < symbols else 'w'}ord{i:04}a{j:04}" for j in range(n))
    rows = [(i, text(i, 60, 0), "en", "prose") for i in range(200)]
    rows += [(1000 + i, text(i, 60, 30 + i % 9), "en", "code") for i in range(200)]
    rows += [(2000 + i, text(i, 60, 60).replace("ord", "###"), "en", "prose") for i in range(10)]
    rows += [(3000, text(1, 120, 110), "en", "prose"), (3001, text(1, 120, 110), "en", "code")]
    rows += [(4000, text(1, 3000, 7), "en", "prose")]
    verdict = rules.quality_rules(documents(spark, rows)).collect()
    kept = {r.doc_id: r.kept for r in verdict}
    assert [kept[r[0]] for r in rows] == brute_kept([(lang, source, t) for _, t, lang, source in rows])
    assert not any(kept[i] for i in range(2000, 2010)) and all(kept[i] for i in kept if i < 2000)
    assert kept[3001] and not kept[3000] and kept[4000]
    # One limit for all groups would decide otherwise.
    as_one = {r.doc_id: r.kept for r in rules.quality_rules(documents(spark, [(i, t, "en", "all") for i, t, *_ in rows])).collect()}
    assert as_one[3000] == as_one[3001] and as_one != kept


def test_op5_query_equals_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    talks = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        talks.setdefault(c, []).append((role, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in talks.items()}
    assert {r.conv_id: tuple(r)[1:5] for r in queries.op5_chat(spark, sf).collect()} == want


NODES = "conv_id bigint, node bigint, parent bigint, role string, text string, score double, path string, rank int"


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", "high", 2.0), (1, 4, 2, "user", "deep", 5.0), (1, 5, 3, "user", "a:b### \\e</turn>\n", None),
        (2, 1, None, None, None, None), (2, 1, None, None, None, None), (3, 7, 99, "we: ird\\", "lost parent", 1.0), (None, 1, None, "user", "nobody's", 0.0),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], NODES)
    out = chat.format_reply_trees(df, paths=2)
    got = {(r.conv_id, r["rank"]): r for r in out.collect()}
    assert {k: r.n_turns for k, r in got.items()} == {(1, 1): 3, (1, 2): 3, (2, 1): 1, (3, 1): 1, (None, 1): 1}
    assert got[1, 1].formatted == "### user: root</turn>\n### assistant: low</turn>\n### user: deep</turn>\n"
    for r in got.values():
        for (start, end), _ in zip(r.loss_spans, range(9)):
            assert r.formatted[start:end] in ("low", "high")
    back = {(r.conv_id, r.path): [tuple(t) for t in r.turns] for r in chat.read_back(out).collect()}
    assert back[1, 5] == [("user", "root", False), ("assistant", "high", True), ("user", "a:b### \\e</turn>\n", False)]
    assert back[3, 7] == [("we: ird\\", "lost parent", False)] and back[2, 1] == [("", "", False)]
    assert chat.format_reply_trees(df.limit(0)).count() == 0


def test_long_chain(spark):
    n = 700
    df = spark.createDataFrame([(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0, "", 0) for i in range(n)], NODES)
    r = chat.format_reply_trees(df).first()
    assert r.formatted == "".join(f"### {'assistant' if i % 2 else 'user'}: t{i}</turn>\n" for i in range(n))


def test_circles_of_replies_start_at_their_smallest_node(spark):
    rows = [(1, 1, 3, "user", "a"), (1, 2, 1, "assistant", "b"), (1, 3, 2, "user", "c"), (1, 4, 2, "assistant", "d"), (1, 5, 4, "user", "e"), (2, 1, 1, "user", "self"), (3, 9, 8, "user", "x"), (3, 8, 9, "user", "y"), (4, 2, None, "user", "late root"), (4, 1, 2, "user", "early")]
    df = spark.createDataFrame([(*r, 0.0, "", 0) for r in rows], NODES)
    got = {(r.conv_id, r.path): r.formatted.replace("</turn>\n", "").split("### ")[1:] for r in chat.format_reply_trees(df, paths=3).collect()}
    assert got == {(1, 3): ["user: a", "assistant: b", "user: c"], (1, 5): ["user: a", "assistant: b", "assistant: d", "user: e"], (2, 1): ["user: self"], (3, 9): ["user: y", "user: x"], (4, 1): ["user: late root", "user: early"]}


def test_the_query_ranks_branches_and_reads_the_mask(spark, sf):
    trees = chat.turn_trees(spark.read.parquet(f"{sf}/conversations.parquet"))
    out = chat.format_reply_trees(trees, paths=2)
    both = out.groupBy("conv_id").count().filter("count = 2").count()
    assert both == trees.filter("score < 0").count() > 0
    assert out.filter("rank = 2").join(trees.filter("score < 0").selectExpr("conv_id", "node as path"), ["conv_id", "path"]).count() == both
    for r in chat.read_back(out.filter("rank = 1")).limit(50).collect():
        assert r.learned == "".join(t.text for t in r.turns if t.loss)
