"""Operator 6: main text of a page as its maximum-scoring run of words and tags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import by_bytes

#: Comments, raw-text elements, tags, and runs of text. What is never closed runs to the end of the page, so a scan is linear.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select)\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that begin and end a block, those without an end tag, and those that a new block closes.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("b i em strong a span u small font".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split()) | INLINE
#: Elements that mark a page's main region.
ROOTS = frozenset(("article", "main"))

#: Labelled pages: in each, what stands between "[[" and "]]" is the article, and the rest isn't.
LABELLED_PAGES = (
    "<header><h1>site</h1></header><nav><ul><li><a>one</a></li><li><a>two</a></li></ul></nav><div class='ad'>buy this now</div>"
    "<article><h1>[[head line]]</h1><p>[[first words of it]]</p><p>[[more <b>words</b> of it]]</p><ul><li>[[a point]]</li></ul></article>"
    "<aside class='sidebar'><p>other pages</p></aside><footer><p>all rights reserved</p></footer>",
    "<header><h1>our site</h1><p>what it is for</p></header><div class='cookie-notice'><p>we use cookies</p></div><div id='content'><h1>[[head line]]</h1><p>[[words of the text]]</p>"
    "<div class='ad'><p>an offer</p></div><blockquote>[[a saying]]</blockquote><table><tr><td>[[cell]]</td></tr></table><pre>[[code]]</pre></div>"
    "<section id='comments'><h2>comments</h2><p>a reader said</p></section><form><label>mail</label><button>send</button></form>",
    "<article><header><h1>[[head line]]</h1></header><p>[[words of the text]]</p><ul class='menu-list'><li>[[a dish]]</li></ul>"
    "<div class='social-science'><p>[[a study]]</p></div><div class='advert'>an offer</div><nav><a>back</a></nav><aside>see too</aside>"
    "<div class='related share'><a>other page</a></div><form>your mail<button>send</button></form><div class='comments'><p>a reader said</p></div></article>",
    "<main><div class='share'><a>post it</a></div><h2>[[head line]]</h2><div>[[bare words]]</div><figure><figcaption>[[what is seen]]</figcaption></figure>"
    "<dl><dt>[[term]]</dt><dd>[[meaning]]</dd></dl><div class='newsletter'><p>join us</p></div><p class='sponsored'>an offer</p><footer><p>about us</p></footer></main>"
    "<div class='banner promo'>an offer</div><div class='related'><h3>more</h3><a>other page</a></div>",
    "<div class='header'>site</div><div class='menu'><a>one</a></div><div class='breadcrumb'><a>up</a></div><div class='post'><p>[[words of the text]]</p>"
    "<h3>[[part]]</h3><p>[[words with <a>a link</a> in them]]</p><ol><li>[[a step]]</li></ol><div class='advertisement'>an offer</div></div>"
    "<div class='widget sidebar'><p>other pages</p></div><div class='popup modal'><p>subscribe</p></div><div class='footer'><p>imprint</p></div>",
    "<article><h1>[[head line]]</h1><div class='partner content'><p>an offer</p></div><div class='content'><p>[[words of the text]]</p></div><p class='notice'>we have moved</p>"
    "<ul class='menu'><li><a>one</a></li><li>two</li></ul><div class='alert'>we are closed</div><div class='gdpr consent'><p>we use cookies</p></div><p>[[more words of it]]</p>"
    "<div class='cta'><p>join us</p></div><section class='feedback'><p>a reader said</p></section></article>",
    "<div class='topbar'>site</div><div class='story'><h1>[[head line]]</h1><p>[[words of the text]]</p><p class='gdpr'>we use cookies</p><p>[[more words of it]]</p></div>"
    "<div class='cta'>join us</div><div id='disqus_thread'><p>a reader said</p></div><div class='discussion'><p>a reader said</p></div><div class='consent'>we use cookies</div>",
    "<body>[[words outside of any element of a bare page]]<p>[[words of a bare page]]</p><div><p>[[and of its end]]</p></div><section><p>[[a part]]</p></section><address>street</address></body>",
    "<div class='comment'><p>a reader said</p></div><div id='respond' class='reply'><p>say so</p></div><div class='alert notice'><p>we are closed</p></div>"
    "<div role='navigation'><a>one</a></div><div class='pagination'><a>next</a></div><article><section class='content'><p>[[words of the text]]</p></section></article>"
    "<div class='ads'>an offer</div><div class='sponsor'>an offer</div><div class='login'>name</div><div class='toolbar'>tools</div><div class='legal copyright'>ours</div>",
)
#: Steps and decay of the fit, labelled pages of a table at most, and how often each labelled page above counts.
STEPS, RATE, DECAY = 400, 0.5, 2e-3
FIT_PAGES, OWN_WEIGHT = 500, 20.0
#: Score of a word of a good block, and the least cost of a tag.
WORD, TAG = 1.0, 0.01


@dataclass
class Weights:
    """Log odds by element name ("<p"), class or id word (".ad") and place ("in root", "outside root"), and the share of each tag outside."""

    odds: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    outside: dict[str, float] = field(default_factory=dict)

    def of(self, features) -> float:
        return self.bias + sum(self.odds.get(f, 0.0) for f in features)

    def holds(self, features) -> bool:
        """Whether an open element is a root or has a name that speaks for an article, so that its tags are the article's own."""
        return "in root" in features or any(f[0] == "." and self.odds.get(f, 0.0) > 0 for f in features)

    def tag(self, name: str) -> float:
        return -TAG * (1 + 9 * self.outside.get(name, 0.5))


def element_features(tag: str, attributes: str) -> tuple[str, ...]:
    """What the element says about its words: its name, and the words of its class, id and role."""
    out = ["<" + tag] if tag not in ("html", "body") else []
    if attributes and out:
        for m in NAMES.finditer(attributes):
            out += ["." + w for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w]
    return tuple(out)


def scan(html: str) -> Iterator[tuple[str, str | frozenset]]:
    """("tag", name) and ("text", text, features, starts_block) in page order; features are those of all open elements."""
    rooted = re.search(r"<(?:article|main)\b", html, re.I) is not None
    outside = frozenset(["outside root"] if rooted else [])
    stack: list[tuple[str, frozenset, bool]] = []
    now, in_root, fresh = outside, False, True
    for m in TOKEN.finditer(html):
        tag = m[3]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                yield "text", unescape(s) if "&" in s else s, now, fresh
                fresh = False
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        fresh = fresh or block
        if not m[2]:
            if block:
                while stack and stack[-1][0] in CLOSED_BY_BLOCK and (stack[-1][0] not in INLINE or any(t[0] == "p" for t in stack[-4:])):
                    stack.pop()
                now, in_root = stack[-1][1:] if stack else (outside, False)
            yield "tag", tag, now, fresh
            if tag == "br":
                yield "text", " ", now, fresh
            if tag not in VOID and not (m[4] or "").endswith("/"):
                if tag in ROOTS and not in_root:
                    now, in_root = (now - outside) | {"in root"}, True
                now = now.union(element_features(tag, m[4]))
                stack.append((tag, now, in_root))
        else:
            yield "tag", tag, now, fresh
            at = len(stack) - 1
            while at >= 0 and stack[at][0] != tag:
                at -= 1
            if at >= 0:
                del stack[at:]
                now, in_root = stack[-1][1:] if stack else (outside, False)


def labelled_features(html: str, marked: bool) -> Counter:
    """(features, label) of all words and ("<name", label) of all tags of a labelled page, counted.

    Labels come from the marks of LABELLED_PAGES, or else from the page's own article element.
    """
    out, inside = Counter(), False
    for kind, s, features, _ in scan(html):
        if kind == "tag":
            out[s, int(inside if marked else "in root" in features)] += 1
        elif marked:
            for part in re.split(r"(\[\[|\]\])", s):
                inside = part == "[[" if part in ("[[", "]]") else inside
                if part not in ("[[", "]]") and part.split():
                    out[features, int(inside)] += len(part.split())
        elif s.split():
            poor = features & {"<nav", "<aside", "<form", "<footer", "<button"}
            out[features, int("in root" in features and not poor)] += len(s.split())
    return out


def fit(counts: dict[tuple, float]) -> Weights:
    """Logistic regression of the labels on the features, by gradient steps; tags by their share outside."""
    words = sorted(((f, y, n) for (f, y), n in counts.items() if not isinstance(f, str)), key=lambda w: (sorted(w[0]), w[1]))
    names = sorted({x for f, _, _ in words for x in f})
    place = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(words), len(names) + 1))
    for i, (f, _, _) in enumerate(words):
        x[i, [place[k] for k in f]] = 1
    x[:, -1] = 1
    y, n = np.array([w[1] for w in words], float), np.array([w[2] for w in words], float)
    n /= n.sum()
    theta = np.zeros(len(names) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        g = x.T @ (n * (y - 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30))))) - DECAY * theta / len(names)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += RATE / step**0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    tags = {f for f, _ in counts if isinstance(f, str)}
    outside = {t: (counts.get((t, 0), 0) + 1) / (counts.get((t, 0), 0) + counts.get((t, 1), 0) + 2) for t in tags}
    return Weights(dict(zip(names, theta[:-1].tolist())), float(theta[-1]), outside)


def own_counts() -> Counter:
    """Counts of LABELLED_PAGES, each word OWN_WEIGHT times."""
    out = Counter()
    for page in LABELLED_PAGES:
        for k, n in labelled_features(page, True).items():
            out[k] += OWN_WEIGHT * n
    return out


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = FIT_PAGES) -> Weights:
    """Weights from LABELLED_PAGES and at most max_pages pages whose article element labels their words.

    The pages with the smallest id hashes are taken. Only counts by distinct features reach the driver.
    """
    marked = pages.filter(F.col(html_col).cast("string").rlike("(?i)<(article|main)[\\s>]"))
    chosen = marked.select(F.xxhash64(id_col, html_col).alias("_h"), F.col(html_col).cast("string").alias("html")).orderBy("_h").limit(max_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = Counter()
            for html in b.column(0).to_pylist():
                got.update(labelled_features(html, False))
            flat = [("" if isinstance(f, str) else "\n", f if isinstance(f, str) else "\n".join(sorted(f)), y, n) for (f, y), n in got.items()]
            columns = zip(*flat) if flat else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["kind", "features", "label", "n"])

    found = chosen.select("html").mapInArrow(run, "kind string, features string, label int, n bigint").groupBy("kind", "features", "label").agg(F.sum("n")).collect()
    counts = own_counts()
    whole = sum(r[3] for r in found) or 1
    share = sum(n for (f, _), n in counts.items() if not isinstance(f, str)) / whole  # both kinds of pages weigh the same
    for kind, features, label, n in found:
        counts[frozenset(features.split("\n")) - {""} if kind else features, label] += n * share
    return fit(counts)


def main_text(html: str | None, weights: Weights) -> str:
    """The good blocks of the maximum-scoring run, joined by two newlines.

    Words of good elements score WORD. Tags cost only where they part regions: those among words that are poor, and
    not inside a root or an element named as an article. So an article keeps its blocks whatever lies between them.
    """
    scores: list[float] = []
    blocks: list[tuple[int, str]] = []  # token at which it ends, text
    parts: list[str] = []
    held, cache = 0.0, {}
    for kind, s, features, fresh in scan(html or ""):
        if features not in cache:
            good = weights.of(features) > 0
            cache[features] = good, good or weights.holds(features)
        good, free = cache[features]
        if fresh and parts:
            text = " ".join("".join(parts).split())
            if text:
                scores.append(held)
                blocks.append((len(scores) - 1, text))
            parts, held = [], 0.0
        if kind == "tag":
            scores.append(0.0 if free else weights.tag(s))
        elif good:
            parts.append(s)
            held += len(s.split()) * WORD
    text = " ".join("".join(parts).split())
    if text:
        scores.append(held)
        blocks.append((len(scores) - 1, text))
    best, first, last, run, start = 0.0, 0, -1, 0.0, 0
    for i, s in enumerate(scores):  # the first of the best runs
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, first, last = run, start, i
    return "\n\n".join(text for at, text in blocks if first <= at <= last)


def extract_pages(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars of every page.

    Words of elements that the weights call poor score nothing and don't enter the text. A null or
    empty page, or one without words in its best region, gives an empty text. The first of equally
    good regions is taken. A tag, comment or script that is never closed hides the rest of the
    page; long pages take time in proportion to their length, and batches are sliced by bytes.
    Null ids and repeated rows each give a row, an empty table none; further columns are not read.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 2):
            texts = [main_text(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
