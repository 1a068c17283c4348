"""The line CRF's held-out accuracy, the language model against plain Python, and page regions."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tapewatch.llm import html_region, language_model, line_crf, queries
from tests.llm.cases import TEXTS, documents


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_op3_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == y for r, y in held) / len(held) >= 0.95
    assert all(r.predicted for r, y in held if y == 1)


def test_labels_of_the_held_out_fold_are_not_used(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - quality, quality) as quality")
    a, b = line_crf.fit_model(docs, labels), line_crf.fit_model(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.scale == b.scale


def test_crf_cases(spark):
    model = line_crf.fit([(*line_crf.line_measures(t), i % 2) for i, (_, t, *_) in enumerate(TEXTS)])
    rows = line_crf.score_documents(documents(spark), model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, *_ in TEXTS)
    assert all(0 <= r.score <= 1 for r in rows)
    assert line_crf.score_documents(documents(spark, []), model).count() == 0
    assert 0 <= line_crf.score_documents(documents(spark), line_crf.fit([])).first().score <= 1


def test_repetition_after_a_clean_opening_is_measured():
    clean = [f"w{i}" for i in range(200)]
    loop = "one two three four five".split() * 400
    (opening,), _ = line_crf.line_measures(" ".join(clean))
    (long,), _ = line_crf.line_measures(" ".join(clean + loop))
    (late,), _ = line_crf.line_measures(" ".join([f"w{i}" for i in range(5000)] + loop[:200]))
    at = len(line_crf.CLASSES)
    assert opening[at : at + 2] == [0, 0]
    assert long[at] == pytest.approx(0.975 * 2000 / 2200) and long[at + 1] == pytest.approx(0.975)
    assert late[at] == pytest.approx(0.975 * 200 / 5200) and late[at + 1] == pytest.approx(0.975)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    model = line_crf.Model(rng.normal(size=4), rng.normal(size=(2, 2)))
    lengths = np.array([3, 1, 5, 0, 2])
    x = rng.normal(size=(lengths.sum(), 4))
    got, at = model.marginals(x, lengths), 0
    for n in lengths:
        weight = np.zeros((n, 2))
        for mask in range(1 << n):
            y = [mask >> i & 1 for i in range(n)]
            s = math.exp(sum(x[at + i] @ model.weights for i in range(n) if y[i]) + sum(model.trans[y[i - 1], y[i]] for i in range(1, n)))
            for i in range(n):
                weight[i, y[i]] += s
        assert np.allclose(got[at : at + n], weight[:, 1] / weight.sum(1))
        at += n


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    lengths = np.array([4, 3, 1])
    starts = np.cumsum(lengths) - lengths
    x, y = rng.normal(size=(8, 3)), rng.integers(0, 2, 8).astype(float)

    def likelihood(theta):
        w, t, total = theta[:3], theta[3:].reshape(2, 2), 0.0
        for s, n in zip(starts, lengths):
            score = lambda v: sum(x[s + i] @ w for i in range(n) if v[i]) + sum(t[int(v[i - 1]), int(v[i])] for i in range(1, n))  # noqa: E731, B023
            total += score(y[s : s + n]) - math.log(sum(math.exp(score([m >> i & 1 for i in range(n)])) for m in range(1 << n)))
        return total

    theta = rng.normal(size=7)
    gw, gt = line_crf._gradient(x, y, lengths, starts, theta[:3], theta[3:].reshape(2, 2))
    want = [(likelihood(theta + d) - likelihood(theta - d)) / 2e-5 for d in 1e-5 * np.eye(7)]
    assert np.allclose(np.concatenate([gw, gt.ravel()]), want, atol=1e-5)


UP = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_model(docs, learn, masses=language_model.MASSES):
    """Walks an automaton of dictionaries token by token: states are tuples of tokens, None is the end of a text."""
    split = lambda t: [*re.findall("[^\x20\x09-\x0d]+", "".join(UP.get(c, c) for c in t or "")), None]
    arcs, visits = Counter(), Counter()
    for (_, t), ok in zip(docs, learn):
        if ok:
            w = [None, *split(t)]
            for i in range(1, len(w)):
                for k in range(min(i, language_model.ORDER - 1) + 1):
                    arcs[tuple(w[i - k : i]), w[i]] += 1
                    visits[tuple(w[i - k : i])] += 1
    n, v, out = visits[()], sum(not s for s, _ in arcs), []

    def weight(state, token):
        if not state:
            return (arcs[(), token] + 0.5) / (n + 0.5 * (v + 1))
        mass = masses[len(state) + 1]
        low = weight(state[1:], token)
        if not visits[state]:
            return low
        return (arcs[state, token] + mass * low) / (visits[state] + mass)

    for (i, t), ok in zip(docs, learn):
        state, base, score, known = (None,), 0.0, 0.0, 0
        for token in split(t):
            known += arcs[(), token] > 0
            base += math.log10(weight((), token))
            score += math.log10(weight(state, token))
            state = (*state, token)[-(language_model.ORDER - 1) :]
        out.append((str(i), ok, len(split(t)), known, n, base, score))
    return sorted(out)


def same(rows, want):
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_op9_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(r.doc_id, not r.held_out, *tuple(r)[2:]) for r in queries.op9_language_model(spark, sf).collect()]
    want = brute_model(docs, [fold(i) != 1 for i, _ in docs])
    got = sorted((str(i), *rest) for i, *rest in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    held = [g for g in got if not g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_language_model_cases(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    learn = [(i or 0) % 2 == 1 for i, *_ in TEXTS]
    for size in (1, 300, 1 << 24):
        same(language_model.score_texts(docs, F.col("doc_id") % 2 == 1, block_bytes=size).collect(), brute_model([t[:2] for t in TEXTS], learn))
    same(language_model.score_texts(docs.repartition(3), F.lit(False), materialize=True).collect(), brute_model([t[:2] for t in TEXTS], [False] * len(TEXTS)))
    assert language_model.score_texts(documents(spark, []), F.lit(True)).count() == 0


def test_totals_beyond_32_bits():
    for most in (0, 255, 256, 70_000, 2**32 - 1, 2**32, 2**50):
        x = np.array([0, 1, most], np.uint64)
        packed, width = language_model.narrow(x)
        assert language_model.unplanes(packed, f"u{width}").tolist() == x.tolist()


def test_arcs_of_a_state_add_up_to_one():
    """Over all words, the end and one unknown word."""
    texts = [b"a b a c", b"b a", b"c"]
    words = [b"a", b"b", b"c", b"unknown"]
    arcs = brute_arcs(texts)
    for state in [(), (None,), (b"a",), (b"b", b"a"), (None, b"b"), (b"c", b"c")]:
        assert sum(arcs(state, w) for w in [*words, None]) == pytest.approx(1)


def brute_arcs(texts):
    seen, visits = Counter(), Counter()
    for t in texts:
        w = [None, *t.split(), None]
        for i in range(1, len(w)):
            for k in range(min(i, language_model.ORDER - 1) + 1):
                seen[tuple(w[i - k : i]), w[i]] += 1
                visits[tuple(w[i - k : i])] += 1
    v = sum(not s for s, _ in seen)

    def weight(state, token):
        if not state:
            return (seen[(), token] + 0.5) / (visits[()] + 0.5 * (v + 1))
        low = weight(state[1:], token)
        mass = language_model.MASSES[len(state) + 1]
        return (seen[state, token] + mass * low) / (visits[state] + mass) if visits[state] else low

    return weight


def test_texts_that_occur_twice_score_apart(spark):
    """A learned text that occurs twice scores higher a token than one that occurs once, in four of five such pairs."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    count = Counter(r.text for r in docs.collect() if fold(r.doc_id) != 1)
    rows = [r for r in queries.op9_language_model(spark, sf).join(docs, "doc_id").collect() if not r.held_out and r.n_tokens > 50]
    twice, once = ([r.score / r.n_tokens for r in rows if count[r.text] == k] for k in (2, 1))
    assert twice and np.mean([x > y for x in twice for y in once]) > 0.8


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies a lot here</div>{body}<aside class="sidebar"><p>More to read today</p></aside>
<section id="comments"><p>First! said a reader</p></section><form><label>Mail</label><input value=">"><button>Send</button></form>
<footer>&copy; us and other words at the end</footer></body></html>"""


OWN = html_region.fit(html_region.own_counts())


@pytest.mark.parametrize(("body", "want"), [
    ("<article><h1>A &amp; B</h1><p>One  two\n three.<p>Four <b>five</b>.<br>Six</article>", "A & B\n\nOne two three.\n\nFour five. Six"),
    ("<main><h2>Head</h2><p>Some words here</p><div class='ad'>Buy now " + "really " * 40 + "</div><p>Last words &lt;b&gt; &#233;&nbsp;x</p><ul><li>a</li><li>b</li></ul></main>", "Head\n\nSome words here\n\nLast words <b> é x\n\na\n\nb"),
    ("<div><h1>Plain</h1><p>No article element stands here at all</p><script>var a = '<p>x</p>';</script><p>but text does</p></div>", "Plain\n\nNo article element stands here at all\n\nbut text does"),
    ("<article><p>A</p></article>", "A"),
    ("", ""),
])
def test_main_text(body, want):
    assert html_region.main_text(PAGE.format(body=body), OWN) == want


def plain(page):
    return page.replace("[[", "").replace("]]", "")


def marked(page):
    return "\n\n".join(" ".join(re.sub("<[^>]*>", "", x).split()) for x in re.findall(r"\[\[(.*?)\]\]", page))


def test_labelled_pages_and_what_the_weights_and_the_run_do():
    pages = html_region.LABELLED_PAGES
    assert [html_region.main_text(plain(p), OWN) for p in pages] == [marked(p) for p in pages]
    blind = html_region.Weights(bias=1.0)
    assert all(html_region.main_text(plain(p), blind) != marked(p) for p in pages[:-2])
    # Two good paragraphs with a menu between: only the better one's region is taken, without tag costs both.
    far = "<p>one two</p><nav>" + "<a>x</a>" * 60 + "</nav><p>three four five</p>"
    assert html_region.main_text(far, OWN) == "three four five"
    free = html_region.Weights(OWN.odds, OWN.bias, dict.fromkeys([*OWN.outside, "nav", "a"], -1 / 9))
    assert html_region.main_text(far, free) == "one two\n\nthree four five"


def test_article_text_with_odd_class_names_stays():
    page = "<nav><a>up</a></nav><article><h1>Head</h1><p class='noticed'>a word of it</p><ul class='menu-list'><li>soup</li></ul><div class='social-science'><p>study</p></div><div class='ad'>buy</div></article>"
    assert html_region.main_text(page, OWN) == "Head\n\na word of it\n\nsoup\n\nstudy"


@pytest.mark.parametrize("between", [
    "<figure><img><img></figure>" * 40, "<div><span></span></div>" * 60, "<div class='ad'><a>buy</a></div>" * 300, "<nav>" + "<li><a>x</a></li>" * 300 + "</nav>",
    "<form>" + "<label>mail</label><input>" * 200 + "</form>", "<div class='q7zx'><i></i></div>" * 200, "<table>" + "<tr><td></td></tr>" * 300 + "</table>",
])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div class='w1'>{}</div></main>", "<div id='content'>{}</div>", "<nav><a>up</a></nav><article><section class='kq'>{}</section></article><footer>us</footer>"])
def test_no_block_of_an_article_is_lost_whatever_lies_between(between, around):
    page = around.format(f"<p>one two three</p>{between}<p>four five six seven</p>")
    assert html_region.main_text(page, OWN) == "one two three\n\nfour five six seven"


def test_empty_elements_of_a_plain_page_part_nothing():
    assert html_region.main_text("<p>one two</p>" + "<div><span></span></div>" * 60 + "<p>three four five</p>", OWN) == "one two\n\nthree four five"


@pytest.mark.parametrize("other", [
    "<ul class='menu'><li><a>one</a></li><li>two</li></ul>", "<div class='notice'>we moved</div>", "<p class='notice'>we moved</p>", "<div class='alert'><p>we are closed</p></div>",
    "<section class='feedback'><p>a reader said</p></section>", "<div class='partner-content'><p>an offer</p></div>", "<div id='comments'><div class='comment'><p>a reader said</p></div></div>",
])
def test_notices_menus_adverts_and_comments_inside_an_article_go(other):
    assert html_region.main_text(f"<article><h1>Head</h1><p>one two three</p>{other}<p>four five</p></article>", OWN) == "Head\n\none two three\n\nfour five"


@pytest.mark.parametrize("other", ["disqus_thread", "gdpr", "cta", "topbar", "discussion", "consent"])
def test_named_blocks_beside_a_plain_text_go(other):
    for page in ("{o}<div><p>one two three</p><p>four five</p></div>", "<div><p>one two three</p><p>four five</p></div>{o}", "<div class='k1'><p>one two three</p>{o}<p>four five</p></div>"):
        assert html_region.main_text(page.format(o=f"<div class='{other}'><p>words of it</p></div>"), OWN) == "one two three\n\nfour five"


def test_names_that_are_random_strings_keep_all_text_of_the_root():
    rng = np.random.default_rng(5)
    name = lambda: "".join(rng.choice(list("bcdfghjkqvwxz"), 7))
    for _ in range(50):
        body = "".join(f"<{t} class='{name()} {name()}' id='{name()}'><p>block {k}</p></{t}>" for k, t in enumerate(rng.choice(["div", "section", "span"], 6)))
        page = f"<nav class='{name()}'><a>up</a></nav><div class='{name()}'><article class='{name()}'>{body}</article></div><footer class='{name()}'>us</footer>"
        assert html_region.main_text(page, OWN) == "\n\n".join(f"block {k}" for k in range(6))


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a b="' * 170_000, "<!" * 500_000, "<script" * 150_000, "<!--" * 250_000, "<a b='x\">" * 110_000])
def test_time_is_linear_in_the_page(page):
    began = time.time()
    html_region.main_text(page, OWN)
    assert time.time() - began < 5


def test_op6_query(spark):
    import html as h

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_page_cases(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>unclosed <b>words", "x"), (2, "u", "<p>unclosed <b>words", "x"), (3, "u", "<!-- never ends <p>a</p>", "x"), (4, "u", "a < b & c <", "x"), (5, "u", "<p>" + "word " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = html_region.extract_pages(pages, html_region.fit_weights(pages)).collect()
    assert sorted((str(r.page_id), r.text[:20], r.n_chars) for r in out) == sorted([("1", "", 0), ("None", "", 0), ("2", "unclosed words", 14), ("2", "unclosed words", 14), ("3", "", 0), ("4", "a < b & c <", 11), ("5", ("word " * 5)[:20], 249_999)])
    assert html_region.extract_pages(pages.limit(0), html_region.fit_weights(pages.limit(0))).count() == 0
