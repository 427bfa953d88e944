"""Operator 10: main text of HTML pages by word counts and link densities of neighbouring blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .trees import Node, fit_tree, shares

#: Comments, declarations and tags. A value in quotes after = reaches to its closing quote, whatever it holds; a quote that
#: none closes is a character like others. Loops don't go back, so that no page takes more than its length.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|(?=<)|\Z)""", re.DOTALL)
#: Of these alone a closing slash ends the element, and only where it isn't the end of an unquoted value.
SELF_CLOSING = re.compile(r"""(?:\A|[\s"'])/\s*\Z""")
FOREIGN = frozenset(["svg", "math"])
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas title textarea audio video head".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Blocks that stand on the stack, so that what they hold knows where it is.
HOLDS = frozenset("article aside body button details dialog div dl fieldset figure footer form header main menu nav ol section select table td th tr ul".split())
AWAY = frozenset("nav footer aside button select menu dialog fieldset".split())
AWAY_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense alert aside author banner breadcrumb breadcrumbs captcha comment comments commentlist respond consent cookie cookies copyright disqus dialog footer foot form gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended register related replies reply search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
HEAD_WORDS = frozenset(["header"])
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
#: In a class name with one of these, an away word says what stands beside or inside the element, not what it is.
LAYOUT_WORDS = frozenset("has with without no layout wrap wrapper container page".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "away", "inside"]


AWAY_KIND, LOOSE, NEITHER, CONTENT = -2, -1, 0, 1


def kind(tag: str, attributes: str, inside: bool) -> int:
    """AWAY_KIND: a menu, header, sidebar, notice, advert or comments; LOOSE: a form, which is away unless an article opens in
    it; CONTENT: an article; NEITHER, also where class names disagree, so that words and links decide."""
    away, content, hidden = tag in AWAY or tag == "header" and not inside, tag in ("article", "main"), False
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                bad = good = False
                for each in value.split():
                    words = {w.lower() for w in SPLIT.split(each)} - {tag}
                    if words & LAYOUT_WORDS:
                        continue
                    if words & AWAY_WORDS or words & HEAD_WORDS and not inside and not words & CONTENT_WORDS:
                        bad = True
                    elif words & CONTENT_WORDS:
                        good = True
                if bad != good:
                    away |= bad
                    content |= good
            elif name == "role":
                away |= value.lower() in AWAY_ROLES
                content |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                hidden = True
    if tag in ("body", "html"):
        return NEITHER
    if hidden or away and tag not in ("article", "main"):
        return AWAY_KIND
    if tag == "form" and not content:
        return LOOSE
    return CONTENT if content else NEITHER


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """The page as flat text blocks in order: (text, words, words in links, away, inside)."""
    out: list[tuple[str, int, int, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, and what held before it
    linked, in_link, away, loose, inside, at = [], False, 0, 0, 0, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), min(len(words), len(html.unescape("".join(linked)).split())), int(away + loose > 0), int(inside > 0)))
        parts, linked = [], []

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if tag not in FOREIGN or not SELF_CLOSING.search(m[3]):
                end = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body\b)", re.IGNORECASE).search(page, at)
                at = end.end() if end else (at if tag == "head" else n)
            continue
        if tag == "a":
            in_link = not closing
            if parts:
                linked.append(" ")
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in BLOCK:
            continue
        close()
        if tag in HOLDS:
            if not closing:
                k = kind(tag, m[3], inside > 0)
                stack.append((tag, away, loose, inside))
                away, loose, inside = away + (k == AWAY_KIND), (0 if k == CONTENT else loose + (k == LOOSE)), inside + (k == CONTENT)
            elif any(x[0] == tag for x in stack):
                in_link = False
                while True:
                    t, away, loose, inside = stack.pop()
                    if t == tag:
                        break
    close()
    return out


def features(found: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """FEATURES of each block; beyond the page's ends there are no words and no links."""
    x = np.zeros((len(found), len(FEATURES)))
    if found:
        words = np.array([b[1] for b in found], float)
        density = np.array([b[2] for b in found], float) / words
        x[:, 0], x[:, 1] = words, density
        x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = words[:-1], density[:-1], words[1:], density[1:]
        x[:, 6], x[:, 7] = [b[3] for b in found], [b[4] for b in found]
    return x


def labelled_page(rng: np.random.Generator) -> str:
    """One made-up page of a usual layout; blocks of the article begin with MARK. Text round it comes in elements that say
    what it is or in ones that don't; the article in an element of its own, in a plain one, or in none, and at
    times in a form or a box that is named after a sidebar."""
    r = rng.random
    words = lambda lo, hi: " ".join(["word"] * int(rng.integers(lo, hi)))
    link = lambda lo, hi: f'<a href="/x">{words(lo, hi)}</a>'
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    bare = r() < 0.2
    own = pick("", "", "<article>", "<main>", '<div class="post-content">', '<section id="story">')
    said = lambda inner, *tags: (lambda t: f"{t}{inner}</{t[1:].split(' ')[0].rstrip('>')}>")(pick(*tags))
    menu = "<ul>" + "".join(f"<li>{link(1, 5)}</li>" for _ in range(int(rng.integers(2, 9)))) + "</ul>"
    before = [] if bare else [said(menu, "<nav>", '<div class="menu">', '<div class="x">', "<div>")]
    if not bare and r() < 0.6:
        before.append(said(f"<p>{words(2, 40)}</p>", '<div class="cookie-notice">', '<div class="ad">', '<div class="banner">', "<header>"))
    body = []
    for k in range(int(rng.integers(1, 4) if bare else rng.integers(3, 13))):
        short = own and r() < 0.35 or k == 0 and not bare
        tag = "h1" if k == 0 and not bare else "h2" if own and r() < 0.1 else "p"
        text = words(1, 9) if short else words(15, 150)
        body.append(f"<{tag}>{MARK} {text}{' ' + link(1, 9) if tag == 'p' and not short and r() < 0.3 else ''}</{tag}>")
        if own and r() < 0.15:
            body.append(said(f"<p>{pick(words, link)(2, 30)}</p>", "<aside>", '<div class="related">', '<div class="share">'))
    article = "\n".join(body)
    article = said(article, own) if own else article
    wrap = "" if bare or r() < 0.7 else pick('<div class="content-sidebar-wrap">', '<div class="has-sidebar">', "<form>" if own else "<div>")
    article = said(article, wrap) if wrap else article
    after = []
    if not bare:
        if r() < 0.7:
            after.append(said("<ul>" + "".join(f"<li>{link(1, 8)}</li>" for _ in range(int(rng.integers(1, 7)))) + "</ul>", "<aside>", '<div class="related">', "<div>", "<div>"))
        for _ in range(int(rng.integers(0, 4))):
            after.append(said(f"<p>{words(3, 60)}</p>", '<div class="comments">', '<div id="sidebar">', "<form>", '<div class="newsletter">'))
        after.append(said(f"<p>{words(2, 9)} {link(1, 2) if r() < 0.3 else ''}</p>", "<footer>", "<footer>", '<div class="footer">', "<div>"))
    return f"<html><body>{''.join(before)}{article}{''.join(after)}</body></html>"


MARK = "article:"


def labelled(pages: int = 120, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: the blocks of ``pages`` made-up pages, read as any page is, 1 for article text. Deterministic;
    some fifteen hundred rows."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        found = [(text, words - text.startswith(MARK), links, away, inside) for text, words, links, away, inside in blocks(labelled_page(rng))]
        xs.append(features(found))
        ys += [int(b[0].startswith(MARK)) for b in found]
    return np.concatenate(xs), np.array(ys)


@cache
def classifier() -> Node:
    return fit_tree(*labelled(), depth=6, least=3)


def main_texts(found: list[list[tuple[str, int, int, int, int]]], tree: Node) -> list[str]:
    keep = shares(tree, np.concatenate([features(f) for f in found])) >= 0.5 if found else []
    out, at = [], 0
    for f in found:
        out.append("\n".join(b[0] for b, k in zip(f, keep[at : at + len(f)], strict=True) if k))
        at += len(f)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Node | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole html.

    Null and empty html, and pages without article text, give an empty text. Unclosed and unmatched tags, cut-off
    tags and comments are read as browsers do; a value whose quote isn't closed ends at the tag's first >. Rows that repeat are rows of the result; null ids and urls are
    kept; other columns are ignored. An empty table gives no rows.
    """
    tree = tree or classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = main_texts([blocks(p or "") for p in part.column(2).to_pylist()], tree)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
