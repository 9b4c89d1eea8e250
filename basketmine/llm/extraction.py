"""Main-text extraction: boosted trees over DOM nodes and hierarchical decoding.

Every node gets the probability that its subtree is main text.  The decoder
then gives each subtree one of three verdicts, from the leaves up: all main,
all boilerplate, or mixed, where the children decide.  Below "all" verdicts
there is no choice left, so a node and its descendants never contradict each
other.

The trees are fitted on a bounded, deterministic sample of the pages themselves.
Pages that mark their article with the `article` element serve as seeds: their
blocks inside it are main, the rest is not.  Copies of a page are one seed.  To
learn other layouts as well, each seed's text is set again in varied layouts
(containers, menus, notices, side bars, forms, reader comments, with usual class
and id words) whose labels are known by construction.  Where no page can be a seed,
the trees learn from such layouts of invented sentences alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmine.llm.boosting import BoostedTrees
from basketmine.llm.common import hash_sample
from basketmine.llm.dom import N_FEATURES, Page

MAX_SEEDS = 300          # pages the trees are fitted on
MAX_SEED_CHARS = 20_000  # longer pages are no seeds (they are extracted like any other)
LAYOUTS = 3              # varied layouts per seed
INVENTED = 100           # invented stories if there is no seed
MIXED_COST = 0.7         # what a mixed verdict costs, in log units
SLICE = 200              # pages whose nodes are scored at a time
MARK = "\x02"            # stands before main text in training layouts
ARTICLE = re.compile("(?i)<article[^>]*>")

SCHEMA = "text string, n_chars long, n_nodes int"


# ------------------------------------------------------------- training pages

def _labels(page: Page, main_pieces: list[bool]) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the nodes with text: is most of the subtree's text main?"""
    n = len(page.nodes)
    main, total = [0] * n, [0] * n
    for (at, _, data), is_main in zip(page.pieces, main_pieces):
        size = len(data.strip())
        total[at] += size
        main[at] += size * is_main
    for i in range(n - 1, 0, -1):
        main[page.nodes[i].parent] += main[i]
        total[page.nodes[i].parent] += total[i]
    rows = page.features()
    keep = [i for i in range(n) if total[i]]
    return [rows[i] for i in keep], [int(2 * main[i] > total[i]) for i in keep]


def _in_article(page: Page) -> list[bool]:
    inside = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        inside[i] = i > 0 and (node.tag == "article" or inside[node.parent])
    return [inside[at] for at, _, _ in page.pieces]


def _blocks(page: Page, wanted: list[bool]) -> list[str]:
    out, last = [], None
    for (_, block, data), ok in zip(page.pieces, wanted):
        if ok and data.strip():
            if block != last:
                out.append("")
                last = block
            out[-1] += data
    return [" ".join(b.split()) for b in out if b.strip()]


def _shortened(rng: random.Random, html: str, main: list[str]) -> str:
    """The seed page with an article of a few words."""
    start = ARTICLE.search(html).end()
    close = re.compile("(?i)</article").search(html, start)
    end = close.start() if close else len(html)
    words = escape(" ".join(rng.choice(main).split()[:rng.randint(1, 12)]))
    return f"{html[:start]}<h1>{words[:60]}</h1><p>{words}</p>{html[end:]}"


# Containers of the main text and of boilerplate in the layouts.
_MAIN = [("article", ""), ("main", ""), ("div", 'class="post-content"'), ("div", 'id="content"'),
         ("section", 'class="article-body"'), ("div", 'class="entry"'), ("div", 'class="story text"'), ("div", "")]
_MENU = [("nav", ""), ("div", 'class="menu"'), ("ul", 'class="navbar"'), ("div", 'id="breadcrumbs"')]
_HEAD = [("header", ""), ("div", 'class="masthead"'), ("div", 'id="header"')]
_FOOT = [("footer", ""), ("div", 'id="footer"'), ("div", 'class="site-footer copyright"')]
_SIDE = [("aside", ""), ("div", 'class="sidebar"'), ("div", 'class="widget related"'), ("section", 'class="recommended"')]
_NOTE = [("div", 'class="cookie-notice"'), ("div", 'id="consent" role="dialog"'), ("div", 'class="alert banner"'),
         ("section", 'class="newsletter"'), ("p", 'class="notice"')]
_AD = [("div", 'class="ad"'), ("div", 'class="advertisement"'), ("div", 'id="sponsored"'), ("aside", 'class="promo"')]
_TALK = [("section", 'id="comments"'), ("div", 'class="comment-list"'), ("div", 'class="discussion replies"'), ("ol", 'class="comments"')]
_SHARE = [("div", 'class="share social"'), ("ul", 'class="social"')]


def _wrap(rng, kinds, inner: str) -> str:
    tag, attrs = rng.choice(kinds)
    return f"<{tag}{' ' + attrs if attrs else ''}>{inner}</{tag}>"


def _layout(rng: random.Random, main: list[str], other: list[str]) -> str:
    """A page of known labels: main text pieces begin with MARK."""
    def some(k, most=400):
        return [escape(rng.choice(other)[:most]) for _ in range(k)]

    def links(k):
        tag = rng.choice(["li", "span", "div"])
        return "".join(f'<{tag}><a href="#">{" ".join(s.split()[:3])}</a></{tag}>' for s in some(k))

    def talk():
        tag = rng.choice(["div", "li", "p", "article"])
        attrs = rng.choice(['class="comment"', 'class="reply"', ""])
        return _wrap(rng, _TALK, "<h3>" + some(1, 20)[0] + "</h3>" + "".join(
            f"<{tag} {attrs}>{f'<p>{s}</p>' if tag != 'p' else s}</{tag}>" for s in some(rng.randint(1, 6), 900)))

    def form():
        return ("<form>" + "".join(f"<label>{s}</label><input name=x>" for s in some(2, 25))
                + f"<p>{some(1, 80)[0]}</p><button>{some(1, 12)[0]}</button></form>")

    tag = rng.choice(["p", "p", "p", "div", "li"])
    body = [f"<{rng.choice(['h1', 'h2'])}>{MARK}{escape(main[0][:80])}</h2>"] if rng.random() < 0.8 else []
    for b in main:
        body.append(f"<{tag}>{MARK}{escape(b)}</{tag}>")
        if rng.random() < 0.12:
            body.append(rng.choice([lambda: _wrap(rng, _AD, some(1)[0]), lambda: _wrap(rng, _SHARE, links(3)),
                                    lambda: _wrap(rng, _NOTE, some(1, 120)[0])])())
        if rng.random() < 0.1:
            body.append(f"<h3>{MARK}{escape(b[:40])}</h3>")
    article = "".join(body)
    if tag == "li":
        article = f"<ul>{article}</ul>"
    article = _wrap(rng, _MAIN, article)
    if rng.random() < 0.4:
        article = f"<div class='{rng.choice(['wrap', 'page', 'container', 'row'])}'>{article}</div>"
    before = [f() for f, p in ((lambda: _wrap(rng, _HEAD, f"<p>{some(1, 60)[0]}</p>"), 0.5),
                               (lambda: _wrap(rng, _MENU, links(rng.randint(3, 9))), 0.8),
                               (lambda: _wrap(rng, _NOTE, f"<p>{some(1, 200)[0]}</p>"), 0.4),
                               (lambda: _wrap(rng, _AD, some(1, 200)[0]), 0.4),
                               (form, 0.25)) if rng.random() < p]
    after = [f() for f, p in ((lambda: _wrap(rng, _SHARE, links(4)), 0.3), (talk, 0.45),
                              (lambda: _wrap(rng, _SIDE, links(rng.randint(2, 6)) + "".join(f"<p>{s}</p>" for s in some(2))), 0.5),
                              (form, 0.25), (lambda: _wrap(rng, _AD, some(1, 300)[0]), 0.3)) if rng.random() < p]
    rng.shuffle(before)
    rng.shuffle(after)
    return ("<html><head><title>x</title></head><body>" + "".join(before) + article + "".join(after)
            + _wrap(rng, _FOOT, some(1, 150)[0]) + "</body></html>")


def _invented(rng: random.Random) -> list[str]:
    """Blocks of a story of invented words."""
    def word():
        return "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def sentence():
        return " ".join(word() for _ in range(rng.randint(4, 18))).capitalize() + rng.choice([".", ".", "?", ", and so on."])

    return [" ".join(sentence() for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 12))]


def fit(seeds: list[str], seed: int = 3) -> BoostedTrees:
    """Fit on the seed pages and their varied layouts; without any usable seed on invented ones."""
    rng, rows, labels = random.Random(seed), [], []

    def learn(page: Page, wanted: list[bool]):
        r, y = _labels(page, wanted)
        rows.extend(r)
        labels.extend(y)

    def learn_layouts(main: list[str], pool: list[str]):
        for _ in range(LAYOUTS):
            few = [" ".join(main[0].split()[:rng.randint(1, 15)])] if rng.random() < 0.2 else main[:40]
            layout = Page(_layout(rng, few, pool))
            learn(layout, [d.lstrip().startswith(MARK) for _, _, d in layout.pieces])

    parsed = [Page(h) for h in seeds]
    articles = [(p, _in_article(p)) for p in parsed]
    mains = [_blocks(p, w) for p, w in articles]
    others = [_blocks(p, [not x for x in w]) for p, w in articles]
    pool = [b for o in others for b in o] + [b for m in mains for b in m[1:]]
    for html, (page, wanted), main in zip(seeds, articles, mains):
        if not main or not pool:
            continue
        learn(page, wanted)
        if ARTICLE.search(html):
            short = Page(_shortened(rng, html, main))
            learn(short, _in_article(short))
        learn_layouts(main, pool)
    if not rows:
        stories = [_invented(rng) for _ in range(INVENTED)]
        pool = [b for story in stories for b in story]
        for story in stories:
            learn_layouts(story, pool)
    x = np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES)
    return BoostedTrees(x, np.array(labels, dtype=np.float64))


# --------------------------------------------------------------- extraction

def decode(page: Page, p: np.ndarray) -> list[bool]:
    """For each node: does its own text belong to the main text?

    Scores are sums of log probabilities over nodes with text.  `all_main` and
    `all_other` score a subtree under one verdict; a mixed subtree takes the
    best verdict of each child, and its own text follows its own probability.
    """
    n = len(page.nodes)
    yes = np.log(np.clip(p, 1e-6, 1)).tolist()
    no = np.log(np.clip(1 - p, 1e-6, 1)).tolist()
    all_main, all_other, best, choice = [0.0] * n, [0.0] * n, [0.0] * n, [""] * n
    for i in range(n - 1, -1, -1):
        node = page.nodes[i]
        if not node.chars:
            choice[i] = "other"
            continue
        kids = node.children
        all_main[i] = yes[i] + sum(all_main[c] for c in kids)
        all_other[i] = no[i] + sum(all_other[c] for c in kids)
        own = max(yes[i], no[i]) if node.own else 0.0
        mixed = own + sum(best[c] for c in kids) - MIXED_COST if kids else float("-inf")
        best[i] = max(all_main[i], all_other[i], mixed)
        choice[i] = "main" if best[i] == all_main[i] else "other" if best[i] == all_other[i] else "mixed"
    kept = [False] * n
    for i in range(n):                                     # a parent comes before its children
        parent = page.nodes[i].parent
        if i and choice[parent] != "mixed":
            choice[i] = choice[parent]
        kept[i] = choice[i] == "main" or choice[i] == "mixed" and yes[i] > no[i]
    return kept


def extract_pages(html: list[str | None], model: BoostedTrees) -> list[tuple[str, int]]:
    """(main text, number of nodes) of each page."""
    pages = [Page(h or "") for h in html]
    rows = [page.features() for page in pages]
    p = model.predict(np.array([r for x in rows for r in x], dtype=np.float64).reshape(-1, N_FEATURES))
    out, at = [], 0
    for page in pages:
        n = len(page.nodes)
        out.append((page.text(decode(page, p[at:at + n])), n))
        at += n
    return out


def train(pages: DataFrame, html: str = "html", max_seeds: int = MAX_SEEDS) -> BoostedTrees:
    """Fit on distinct pages with an `article` element (in any case), at most `max_seeds` of them.

    Pages are told apart and drawn by a hash, so copies never crowd others out and
    the seeds do not depend on the partitioning.  Only hashes are shuffled.
    """
    h = F.col(html)
    able = (pages.filter(h.rlike("(?i)<article") & (F.length(h) <= MAX_SEED_CHARS))
            .select(h.alias("h"), F.xxhash64(h).alias("k")))
    drawn = [r["k"] for r in hash_sample(able.select("k").distinct(), F.col("k"), max_seeds).collect()]
    seeds = able.filter(F.col("k").isin(drawn)).groupBy("k").agg(F.min("h").alias("h"))
    return fit([r["h"] for r in seeds.orderBy("k").collect()])


def main_text(html: Column, model: BoostedTrees) -> Column:
    """Struct of text, n_chars (code points) and n_nodes.

    Defined cases: a null or empty page has an empty text; text outside any
    element counts as its own node at the root; unclosed elements end with their
    parent; scripts, styles and form controls never give text.  Pages are read
    whole, however long; equal pages have equal texts; a node as likely as not is
    kept; an empty table gives no rows.  Only the given column is read, so other
    columns may have any name.
    """
    @F.pandas_udf(SCHEMA)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for start in range(0, len(batch), SLICE):
                part = [h if isinstance(h, str) else None for h in batch[start:start + SLICE]]
                found += [(t, len(t), n) for t, n in extract_pages(part, model)]
            yield pd.DataFrame(found, columns=["text", "n_chars", "n_nodes"])

    return extract(html)
